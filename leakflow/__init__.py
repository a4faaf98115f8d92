"""leakflow: finding, tracing and removing sensitive strings with PySpark DataFrames."""

__version__ = "0.1.0"
