"""weft: a PySpark-native analytics engine for project-knowledge graphs."""

__version__ = "0.1.0"
