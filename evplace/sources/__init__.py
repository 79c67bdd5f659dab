"""Sources of the place-recognition jobs."""
