"""Training-data operators: dedup, tokens, extraction, scoring, formatting, filtering and decontamination of documents."""
