"""Patient-style tabular analytics as Spark DataFrame operators."""
