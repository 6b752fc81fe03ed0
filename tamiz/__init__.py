"""tamiz: a PySpark-native engine for screening complaint records and text corpora."""
