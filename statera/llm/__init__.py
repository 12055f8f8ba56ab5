"""Training-data operators: token storage, sharding, search, mixing, scans, fingerprints, deduplication, packing, toxicity."""
