"""Multimodal dataset analytics expressed as Spark DataFrame jobs."""
