"""Comparative text analytics on Spark."""
