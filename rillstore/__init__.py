"""rillstore: a PySpark-native analytics engine over streams of schema-tagged records."""
