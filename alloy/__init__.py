"""alloy — a PySpark-native Bronze -> Silver -> Gold engine."""

__version__ = "0.1.0"
