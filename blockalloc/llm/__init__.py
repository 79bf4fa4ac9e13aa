"""Training-data operators: search, deduplication, scoring, tokens, packing, extraction."""
