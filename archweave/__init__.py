"""Spark-native analytics over architecture graphs: typed components, links between them, links to the outside."""
