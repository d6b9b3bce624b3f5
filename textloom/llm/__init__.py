"""Operators for large training-text corpora. Nothing else in textloom imports this subpackage."""
