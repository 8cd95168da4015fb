"""Spark-native engine for regions, imagery-like series, embeddings and the tables around them."""
