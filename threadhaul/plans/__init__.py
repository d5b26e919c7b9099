"""Composed plans: message normalisation and the end-to-end export."""
