"""Streaming twins of the batch operators over event-shaped tables."""
