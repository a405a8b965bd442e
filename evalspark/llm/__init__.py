"""Training-data operators: classification, deduplication, mixing and export of text corpora."""
