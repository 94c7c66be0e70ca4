"""Point-in-time panel analytics expressed as Spark DataFrame, SQL, ML and streaming jobs."""
