"""quire: a PySpark-native analytics engine for semi-structured business documents."""
