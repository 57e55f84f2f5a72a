"""Training-data operators: filtering, deduplication, tokenising and packing of large corpora."""
