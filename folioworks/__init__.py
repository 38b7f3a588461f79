"""A Spark-native engine for document triage, extraction and evaluation."""
