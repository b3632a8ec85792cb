"""quern: a PySpark-native analytics and data-processing engine."""
