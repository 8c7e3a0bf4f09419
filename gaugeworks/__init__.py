"""gaugeworks: evaluation analytics expressed as Spark DataFrames."""
