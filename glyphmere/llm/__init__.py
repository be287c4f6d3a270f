"""Training-data operators: scoring, deduplication, labelling, tokenising and packing of documents."""
