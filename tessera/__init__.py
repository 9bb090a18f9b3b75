"""Tessera: timeline, retrieval and evaluation analytics as Spark DataFrame plans."""
