"""Table operators for per-window vectors and class scores, on Spark DataFrames."""

__version__ = "0.1.0"
