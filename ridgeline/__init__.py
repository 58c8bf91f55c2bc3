"""Filtered nearest-neighbour search and vector statistics as Spark DataFrame plans."""

__version__ = "0.0.1"
