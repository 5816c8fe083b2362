"""Entity resolution over names, expressed with Spark DataFrames."""
