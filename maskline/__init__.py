"""maskline: a Spark-native engine that finds, grades and masks personal data."""
