"""Training-data operators: sharding, mixing, fingerprints, quality, PII, deduplication, BPE and licences."""
