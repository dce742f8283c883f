"""A PySpark-native engine for indexing text corpora and answering exact similarity queries over them."""
