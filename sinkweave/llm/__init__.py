"""Training-data operators: sharding, decontamination, deduplication, filters, tokens."""
