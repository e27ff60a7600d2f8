"""Structured Streaming over folders of image files."""
