"""outcrop: a PySpark-native engine for time-coded archives and text corpora."""
