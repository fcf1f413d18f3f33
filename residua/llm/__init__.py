"""Training-data operators: archives, packing, cleaning, dedup, PII, sharding and list filters."""
