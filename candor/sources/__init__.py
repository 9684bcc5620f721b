"""Readers of the corpus formats, and adapters of driver tables."""
