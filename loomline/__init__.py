"""loomline: a PySpark-native engine for curating question/answer and text corpora."""
