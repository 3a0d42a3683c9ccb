"""Skirmish: analytics of two-sided competitive events as Spark jobs."""
