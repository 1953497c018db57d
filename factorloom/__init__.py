"""factorloom: a PySpark-native engine for quantitative factor research over (date, asset) panels."""
