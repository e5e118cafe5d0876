"""acreline: a PySpark-native analytics engine for location-based field operations."""
