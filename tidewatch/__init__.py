"""Event-warning analytics over large collections of time series, as ordinary Spark plans."""
