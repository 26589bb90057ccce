"""A log and text analytics engine on Spark DataFrames."""
