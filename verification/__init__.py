"""Checks of the library on the generated test tables: projections, queries and independent SQL."""
