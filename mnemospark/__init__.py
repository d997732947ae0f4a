"""mnemospark: a PySpark-native analytics engine for agent-memory data."""

__version__ = "0.1.0"
