"""plexmatch: labelled subgraph matching and counting on Spark DataFrames."""
