"""A corpus analytics engine on Spark: ingestion, indexing, hybrid retrieval, taxonomy and citation graph."""
