"""Terrane: price zones and training-data operators as Spark jobs."""
