"""braidline: lineage analytics on Spark DataFrames."""
