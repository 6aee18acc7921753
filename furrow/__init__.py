"""Agricultural and geospatial analytics on the Spark DataFrame API."""
