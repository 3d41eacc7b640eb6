"""The tools over a corpus, and the queries with their SQL."""
