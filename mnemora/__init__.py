"""A PySpark-native analytics engine for conversational memory."""
