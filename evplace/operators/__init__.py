"""Operators of the place-recognition jobs."""
