"""Spark-native analytics for evidence-checked document processing."""
