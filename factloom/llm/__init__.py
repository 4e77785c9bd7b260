"""Training-data operators: tokenising, deduplication, scoring, filtering and packing of text."""
