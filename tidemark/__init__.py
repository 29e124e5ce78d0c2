"""tidemark: land, repair, enrich and serve many time series with Spark."""
