"""lodestar: retrieval analytics over opinion corpora, expressed as Spark DataFrame plans."""
