"""Report compositions and the two-phase label normaliser."""
