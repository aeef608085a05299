"""Fleet telemetry and flow-behaviour analytics on Spark DataFrames."""
