"""Spark-native engine for multimodal document analytics and retrieval."""
