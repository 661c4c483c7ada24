"""Training-data operators: sharding, quality, secrets, dedup, tokenising, extraction, licences, mixing and archives."""
