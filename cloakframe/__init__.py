"""Privacy and governance analytics for text and tables, on Spark."""
