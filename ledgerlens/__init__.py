"""Sales and customer analytics expressed as Spark DataFrame operators."""
