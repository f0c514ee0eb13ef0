"""Training-data operators: encoding, cleaning, scoring, deduplication and packing of ``documents``."""
