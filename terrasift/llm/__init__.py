"""Training-data operators: classifiers, deduplication, search, tokenisation, mixing and formatting."""
