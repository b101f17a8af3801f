"""Literature-signal analytics on Spark."""
