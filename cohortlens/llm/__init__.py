"""Training-data operators: deduplication, language, toxicity, token files, packing and mixing."""
