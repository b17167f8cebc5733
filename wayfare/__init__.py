"""Wayfare: attributed street-network analytics as Spark jobs."""
