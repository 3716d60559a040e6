"""Training-data operators: mixing, language, secrets, duplicates, extraction, pieces, scoring, quality, chat, fingerprints."""
