"""textloom: document and retrieval analytics as Spark DataFrame plans."""
