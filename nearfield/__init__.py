"""nearfield: Spark-native text-to-vector and vector-index analytics."""
