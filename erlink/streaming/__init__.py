"""Streaming extension: records linked as they arrive."""
