"""hyperweave: hypergraph analytics and training-data operators on Spark DataFrames."""
