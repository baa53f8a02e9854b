"""A PySpark-native engine for measuring prose quality at corpus scale."""
