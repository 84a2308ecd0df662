"""loomgraph: graph preparation, sampling, scoring and evaluation on Spark DataFrames."""
