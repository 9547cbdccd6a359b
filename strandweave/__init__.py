"""A property-graph and data-processing engine on Spark DataFrames."""
