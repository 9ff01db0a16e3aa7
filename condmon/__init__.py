"""condmon: condition-monitoring analytics on Spark DataFrames."""
