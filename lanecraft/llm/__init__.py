"""Training-data operators: language ID, near-duplicate search, packing, formatting, mixing, extraction."""
