"""Training-data operators: search, deduplication, filtering, mixing and tokenising of text corpora on Spark."""
