"""codeloom operators."""
