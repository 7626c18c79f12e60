"""codeloom: a Spark-native analytics engine for source repositories and text corpora."""
