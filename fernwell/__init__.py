"""Feedback analytics on Spark."""
