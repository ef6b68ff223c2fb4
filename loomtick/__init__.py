"""loomtick: timestamped streams and their analytics on Spark."""
