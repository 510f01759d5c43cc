"""Symbolic sequence analytics on Spark."""
