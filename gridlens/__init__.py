"""Table, model and text analytics as Spark DataFrame operators."""
