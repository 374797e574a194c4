"""holdfast: ownership-graph analytics expressed as Spark DataFrames."""
