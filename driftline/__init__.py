"""driftline: analytics for the data side of machine-learning operations, on Spark."""
