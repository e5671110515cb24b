"""Structured Streaming jobs over offers and captures."""
