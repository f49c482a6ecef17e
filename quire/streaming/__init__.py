"""Streaming of quire."""
