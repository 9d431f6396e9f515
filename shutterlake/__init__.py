"""Spark-native engine for photo-catalogue analytics and large-scale data preparation."""
