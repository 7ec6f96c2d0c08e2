"""Pointwise text segmentation and tagging on Spark DataFrames."""

__version__ = "0.1.0"
