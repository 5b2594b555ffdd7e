"""Training-data operators: deduplication, mixing, packing, scoring and scanning of documents."""
