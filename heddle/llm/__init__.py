"""Training-data operators: deduplication, filtering, mixing, packing and archives."""
