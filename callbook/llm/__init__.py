"""Training-data operators: near copies, quality, privacy, tokens and vectors."""
