"""lexforge: a PySpark-native analytics engine for legal and regulatory text."""
