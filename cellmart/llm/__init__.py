"""Training-data operators: deduplication, scoring, packing, classification, PII, search, tokenization."""
