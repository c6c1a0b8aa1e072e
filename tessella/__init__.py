"""Tessella: retrieval analytics as Spark DataFrame jobs."""
