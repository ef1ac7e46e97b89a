"""codeloom: code-knowledge analytics expressed as Spark plans."""
