"""Grounded document extraction as Spark DataFrame operators."""
