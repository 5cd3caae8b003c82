"""PySpark-native engine that compares how several outlets report one event."""
