"""Operators for large training-text corpora. Nothing else in contractlake imports this package."""
