"""Region analytics over rasters as Spark jobs."""
