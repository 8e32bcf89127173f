"""Customer-review analytics expressed as Spark DataFrame plans."""
