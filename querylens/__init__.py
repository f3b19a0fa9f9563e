"""querylens: a PySpark-native engine for evaluating text-to-SQL work and the data behind it."""
