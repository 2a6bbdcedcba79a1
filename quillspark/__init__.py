"""Document-retrieval and telemetry analytics as Spark DataFrame operators."""
