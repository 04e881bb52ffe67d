"""Operators for large text corpora: fingerprints, near copies, language, toxicity, tokens, mixing, search."""
