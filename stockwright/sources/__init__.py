"""Reading, auditing, mapping and writing tables."""
