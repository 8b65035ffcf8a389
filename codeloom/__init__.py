"""codeloom: structural questions over source trees, answered with Spark plans."""
