"""PySpark-native coupling analysis: cohorts, sufficient statistics, low-rank maps, geometry, inference and state dynamics."""
