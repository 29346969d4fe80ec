"""PySpark-native analytics for block adjustment of satellite imagery."""

__version__ = "0.1.0"
