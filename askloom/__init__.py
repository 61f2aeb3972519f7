"""A PySpark-native engine for building and auditing synthetic question-answer datasets."""
