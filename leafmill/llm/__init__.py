"""Operators that prepare training data from document, page and vector tables."""
