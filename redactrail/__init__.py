"""redactrail: a PySpark-native engine that audits document-redaction runs."""
