"""Object-level morphometry and training-data preparation on Spark."""
