"""groundcover: aerial imagery to material maps, expressed as Spark DataFrames."""

__version__ = "0.1.0"
