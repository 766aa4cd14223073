"""A Spark-native analytics library for labelled property graphs of software systems, and for text corpora."""
