"""parcela: a PySpark-native engine for captured listing pages and text corpora."""
