"""Spark-native analytics for cells, embeddings, graphs and labels."""
