"""A PySpark-native analytics engine for free-text sample metadata."""
