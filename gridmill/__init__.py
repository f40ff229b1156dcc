"""Gridmill: curation and analysis of electricity-market time series as Spark DataFrame jobs."""
