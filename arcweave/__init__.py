"""arcweave: typed property graphs and graph-shaped data processing on Spark DataFrames."""

__version__ = "0.1.0"
