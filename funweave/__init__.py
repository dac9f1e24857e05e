"""funweave: network-based function prediction and corpus processing on Spark DataFrames."""
