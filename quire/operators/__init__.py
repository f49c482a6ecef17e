"""Operators of quire."""
