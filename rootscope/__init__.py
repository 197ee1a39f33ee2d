"""PySpark-native root-cause analytics over traces, metrics and logs."""

__version__ = "0.1.0"
