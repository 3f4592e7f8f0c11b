"""Training-data operators: deduplication, scans, tokens, archives, packing."""
