"""Training-data operators: filtering, tokenization, packing, deduplication, search and scoring."""
