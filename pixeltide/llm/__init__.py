"""Corpus operators for training data: language, tokens, URLs, duplicates, leaks, language models and quality."""
