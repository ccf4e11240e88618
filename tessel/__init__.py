"""tessel: a PySpark-native engine for graph, document and training-data queries."""
