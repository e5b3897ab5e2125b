"""Training-data operators: cleaning, near-duplicates, privacy, mixing and token output."""
