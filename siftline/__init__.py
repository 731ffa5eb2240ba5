"""siftline: a PySpark-native engine for positional-match and cross-observation analysis."""
