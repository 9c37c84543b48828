"""A PySpark-native analytics engine: SQL front end, spatial search, layouts and tables."""
