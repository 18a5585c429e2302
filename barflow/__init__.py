"""barflow: market-style time series and corpus preparation as Spark jobs."""
