"""Training-data operators: quality rules, secret scans, deduplication, packing,
fingerprints, archives, tokenisation, extraction and quality models."""
