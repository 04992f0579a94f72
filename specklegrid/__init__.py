"""specklegrid: a PySpark-native engine for scientific-image analytics."""
