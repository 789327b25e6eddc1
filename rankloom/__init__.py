"""rankloom: a PySpark-native engine for place scoring, ranking and corpus preparation."""
