"""Document intelligence as Spark DataFrame operations."""
