"""Log lines and event tables as labelled time series, queried on Spark."""

__version__ = "0.1.0"
