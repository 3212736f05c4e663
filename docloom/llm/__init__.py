"""Training-data operators: quality, near-duplicates, packing, sharding, decontamination, secrets, tokens."""
