"""Nonsense-variant and ribosome-footprint analytics as Spark DataFrame operators."""
