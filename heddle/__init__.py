"""heddle: memory, retrieval and training-data operators as Spark DataFrame plans."""
