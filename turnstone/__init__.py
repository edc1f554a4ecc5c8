"""Interaction analytics on Spark."""
