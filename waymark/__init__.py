"""A PySpark-native engine for spatial-reasoning datasets and training-data corpora."""
