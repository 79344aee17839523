"""Clinical retrieval, de-identification and training-data analytics as Spark plans."""
