"""tessera: graph-structured 2-D image alignment as Spark DataFrames."""
