"""A Spark-native engine for catalogue search, reconciliation and training-text preparation."""
