"""lexicade: labelled-text analytics on Spark DataFrames."""
