"""Area-level spatial analytics on Spark DataFrames."""
