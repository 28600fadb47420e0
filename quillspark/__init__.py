"""quillspark: a Spark-native analytics engine for source code and text corpora."""
