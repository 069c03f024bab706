"""A PySpark-native engine for metadata graphs, code analysis, document search and telemetry."""
