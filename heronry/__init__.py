"""Context retrieval, knowledge curation and corpus preparation as Spark DataFrame transformations."""
