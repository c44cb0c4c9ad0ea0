"""Training-data operators: quality, search, deduplication, packing, tokens, secrets, media."""
