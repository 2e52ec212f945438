"""Vector range analytics on Spark: range joins, their index, and the figures around them."""

__version__ = "0.1.0"
