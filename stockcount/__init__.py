"""Visual inventory analytics expressed as Spark DataFrame operators."""
