"""A PySpark-native analytics engine for dumps of business-application configurations."""
