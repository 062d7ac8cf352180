"""Document retrieval and corpus preparation as Spark DataFrame plans."""
