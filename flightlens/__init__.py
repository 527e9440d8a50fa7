"""PySpark-native analytics over unmanned-aircraft flight evidence."""
