"""Transcript and subtitle analytics as Spark DataFrame jobs."""
