"""Clustering operators over point sets."""
