"""Reorder and conversation analytics as Spark DataFrame jobs."""
