"""Procurement analytics expressed as Spark DataFrame transformations."""
