"""Network-flow anomaly analytics expressed as Spark DataFrame operators."""
