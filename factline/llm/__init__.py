"""Training-data operators: quality, dedup, scoring, encoding, sharding and mixing of document corpora."""
