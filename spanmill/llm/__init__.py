"""Training-data operators: decontamination, tokenisation, formatting, filtering, search and deduplication."""
