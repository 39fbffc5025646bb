"""byteloom: Spark-native identification of raw bytes (encoding, language, MIME)."""

__version__ = "0.1.0"
