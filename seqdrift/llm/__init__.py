"""Training-data operators: text quality, deduplication, extraction, privacy, tokens, chat."""
