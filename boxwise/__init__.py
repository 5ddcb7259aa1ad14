"""boxwise: as-of statistical profiles over event and box-score data, as Spark jobs."""
