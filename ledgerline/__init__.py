"""ledgerline: a PySpark-native engine over versioned key-value operation logs."""

__version__ = "0.1.0"
