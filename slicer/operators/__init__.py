"""Operators over DataFrames: traversal, sampling, verification, manifest, two-phase split."""
