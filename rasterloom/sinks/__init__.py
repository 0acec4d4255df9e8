"""Writers: Parquet, CSV and JSON through Spark, PNG files from tasks, one image a group of row bands."""
