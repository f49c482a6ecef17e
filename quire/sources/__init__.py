"""Sources of quire."""
