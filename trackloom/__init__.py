"""Analytics of populations of moving, changing objects on Spark."""
