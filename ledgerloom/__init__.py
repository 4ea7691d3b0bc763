"""ledgerloom: a PySpark-native engine for filings, statements and the texts about them."""

__version__ = "0.1.0"
