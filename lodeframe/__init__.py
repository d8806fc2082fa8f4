"""A PySpark-native engine for catalogue search, consensus, matching, synchronisation and corpus work."""
