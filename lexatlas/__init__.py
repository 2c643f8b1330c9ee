"""Corpus cartography on Spark: extraction, state, search, similarity, maps."""
