"""chronoloom: temporal-graph analytics over Spark DataFrames."""
