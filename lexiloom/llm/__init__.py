"""Training-data operators: scans, deduplication, mixing, scoring and counting of documents."""
