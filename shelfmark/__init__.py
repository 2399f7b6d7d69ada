"""shelfmark: a PySpark-native engine for catalogues of files and objects."""
