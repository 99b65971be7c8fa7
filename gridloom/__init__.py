"""Spark-native analytics for ordered, cyclic sequences of fixed-size symbol boards."""

__version__ = "0.1.0"
