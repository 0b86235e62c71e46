"""Training-data operators: deduplication, tokenisation, search, archives, scoring and mixing."""
