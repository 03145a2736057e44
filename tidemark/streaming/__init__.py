"""Structured Streaming operators; windowed ones also run on a batch frame."""
