"""Learning from, and predicting on, large collections of small labelled graphs, as Spark jobs."""
