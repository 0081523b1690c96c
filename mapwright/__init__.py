"""mapwright: a PySpark-native document-to-requirement mapping engine."""

__version__ = "0.1.0"
