"""codexloom: document-evidence analytics as Spark DataFrame operators."""
