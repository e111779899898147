"""A temporal knowledge graph engine on Spark DataFrames."""
