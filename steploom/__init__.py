"""steploom: Spark-native operators for stepwise question-answering trajectories."""

__version__ = "0.1.0"
