"""Literature-graph analytics on Spark."""
