"""Training-data operators: deduplication, scans, classifiers, tokenizers, search and mixing."""
