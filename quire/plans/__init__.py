"""Plans of quire."""
