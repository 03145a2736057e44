"""Layered batch and streaming analytics expressed as Spark DataFrame operators."""
