"""docketry: a Spark-native engine for versioned document catalogues, hybrid search and evaluation analytics."""
