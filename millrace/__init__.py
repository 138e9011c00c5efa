"""millrace: a Spark-native engine that prepares text corpora for language-model training."""
