"""strandgraph: sequence and labelled-graph analytics expressed as Spark DataFrames."""
