"""Analytics for ensembles of time series, as DataFrame operations on Spark."""
