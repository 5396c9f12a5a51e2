"""Training-data operators: fingerprints, near duplicates, tokens, personal data, secrets, shards, mixes and quality."""
