"""Functional-association networks as Spark DataFrame jobs."""
