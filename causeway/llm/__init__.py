"""Training-data operators: dedup, extraction, quality, mixing, formatting, packing."""
