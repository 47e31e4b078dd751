"""Part of the retrieval analytics library."""
