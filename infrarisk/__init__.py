"""Spark-native urban-infrastructure risk analytics (rule scoring, labels, models, metrics)."""

__version__ = "0.1.0"
