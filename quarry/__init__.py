"""A PySpark-native retrieval and context-assembly engine for source code and documents."""

__version__ = "0.1.0"
