"""Document corpus analytics on Spark: chunking, redaction, retrieval and upkeep as DataFrame operators."""
