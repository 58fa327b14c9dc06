"""A Spark-native engine for tenant datasets, fleet analytics and training-data pipelines."""
