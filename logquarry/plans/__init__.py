"""The query language and its lowering to Spark plans."""
