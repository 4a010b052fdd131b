"""Quarry: Spark-native batch analytics for text, graphs, grids and numbers."""
