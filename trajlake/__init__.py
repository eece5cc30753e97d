"""PySpark-native engine for web-agent trajectory data."""
