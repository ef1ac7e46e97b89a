"""codeloom sources."""
