"""Plans of the place-recognition jobs."""
