"""A PySpark-native engine: ref mirroring plus star-schema plans, DataFrames throughout."""
