"""attesta: a PySpark-native engine for auditing documents against a bounded corpus of sources."""

__version__ = "0.1.0"
