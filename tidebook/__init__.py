"""Market-by-order analytics on Spark: scans, merge order, routing, order books and their views, as DataFrames."""

__version__ = "0.2.0"
