"""Functions of quire."""
