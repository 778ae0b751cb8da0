"""Training-data operators: deduplication, filtering, scoring, packing and placement of documents."""
