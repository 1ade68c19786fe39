"""loomgraph: code-structure graph analytics expressed with Spark DataFrames."""
