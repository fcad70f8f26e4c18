"""Listing-market analytics on Spark: sources, functions, operators, plans and streams."""
