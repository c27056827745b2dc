"""Referentially intact, masked subsets of relational data as Spark plans."""
