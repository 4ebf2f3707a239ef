"""rasterloom: Spark-native analytics for polygonal sites watched by multi-band rasters."""
