"""Analytics of two-team drafts on Spark: ingest, statistics, models and decisions as DataFrames."""
