"""Reading and writing corpora and index tables."""
