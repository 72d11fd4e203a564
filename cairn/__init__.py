"""cairn: Spark-native analytics over a curated product-knowledge graph."""
