"""Functions of the place-recognition jobs."""
