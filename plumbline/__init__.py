"""Address tables and corpus preparation as Spark DataFrame operators."""
