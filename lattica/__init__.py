"""Lattica: graph and code-knowledge analytics written as Spark DataFrame plans."""
