"""codeloom plans."""
