"""Evidence analytics on Spark: facts, concepts, relations, search, reports and graph measures as DataFrame operators."""
