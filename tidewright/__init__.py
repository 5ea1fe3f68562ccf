"""Time-series features, validation, risk and evaluation as Spark DataFrame operators."""
