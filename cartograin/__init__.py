"""Cartograin: geo-point clustering, aggregation and text analytics expressed as Spark jobs."""
