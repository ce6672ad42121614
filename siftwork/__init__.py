"""A PySpark-native engine for finding secrets and personal data in text corpora."""
