"""millrace: corpus curation and relational analytics as Spark plans."""
