"""Loaders of the relations."""
