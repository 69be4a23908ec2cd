"""A declarative analytics engine that runs on Spark DataFrames."""
