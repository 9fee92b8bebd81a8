"""Spark-native analytics for annotated conversational corpora and the graphs derived from them."""
