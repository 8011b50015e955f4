"""Problem-clustered analytics over repeated attempts, as Spark DataFrame plans."""
