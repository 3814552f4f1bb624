"""Whole jobs made of the operators, and the registered queries with their SQL."""
