"""orbweave: subgraph mining on Spark DataFrames."""
