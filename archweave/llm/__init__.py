"""Training-data operators: media, search, counts, privacy, mixing, tokens, quality, toxicity, pages, copies."""
