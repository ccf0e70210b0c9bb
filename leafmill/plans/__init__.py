"""Queries by name, and independent SQL for them."""
