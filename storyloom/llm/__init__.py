"""Training-data operators: near-dedup, quality, decontamination, language, tokens, secrets."""
