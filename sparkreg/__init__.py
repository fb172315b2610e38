"""sparkreg: statistical regression on Spark DataFrames."""
