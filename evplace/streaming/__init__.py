"""Streaming of the place-recognition jobs."""
