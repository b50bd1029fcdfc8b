"""Analytical queries over the star schema, as declared blocks."""
