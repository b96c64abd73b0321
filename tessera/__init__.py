"""tessera: source-code analytics as Spark DataFrames."""
