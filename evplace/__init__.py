"""Place recognition on event-camera recordings as Spark jobs: DataFrames in, DataFrames out."""
