"""skein: a PySpark-native analytics engine for knowledge graphs."""
