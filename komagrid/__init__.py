"""Page-text analytics on Spark: every stage is a DataFrame -> DataFrame function."""

__version__ = "0.1.0"
