"""tessera: document knowledge, evidence retrieval and quality gates on Spark DataFrames."""
