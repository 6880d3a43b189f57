"""Search-run analytics on Spark: candidate sets, evaluations, telemetry and job ledgers as DataFrames."""
