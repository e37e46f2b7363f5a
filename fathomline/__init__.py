"""fathomline: a PySpark-native analytics engine for operational data."""

__version__ = "0.1.0"
