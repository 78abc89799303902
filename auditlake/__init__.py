"""auditlake: a PySpark-native engine for auditing machine-generated text and code corpora."""
