"""Emberline: corpus, graph, blend and dialogue analytics as Spark jobs."""
