"""Clickstream analytics on Spark: layered event tables, sessions, funnels, streaming and publishing."""
