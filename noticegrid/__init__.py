"""Notice intelligence and unit-inventory analytics as Spark DataFrame operators."""
