"""Structured Streaming form of the pairwise counts."""
