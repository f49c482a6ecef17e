"""Sinks of quire."""
