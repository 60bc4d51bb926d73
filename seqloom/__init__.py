"""seqloom: a PySpark-native engine for labelled event-sequence text."""
