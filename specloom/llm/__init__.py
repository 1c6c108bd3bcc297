"""Training-data operators: dedup, archives, tokens, shards, privacy, quality, packing."""
