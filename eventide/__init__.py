"""A Spark engine that follows how events surface across content platforms."""
