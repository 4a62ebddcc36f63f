"""Geospatial and mobility analytics as Spark DataFrame jobs."""
