"""Part of a PySpark-native engine for evaluating retrieval-augmented generation."""
