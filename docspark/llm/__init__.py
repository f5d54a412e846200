"""Operators for preparing training corpora. Nothing else in docspark imports this package."""
