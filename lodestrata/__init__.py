"""lodestrata: Spark-native factor research and panel data engine."""

__version__ = "0.1.0"
