"""tessel: federated record search, ranking and training-data preparation on Spark."""
