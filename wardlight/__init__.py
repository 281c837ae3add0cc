"""Clinical text analytics on Spark: retrieval, extraction, case text, streams."""
