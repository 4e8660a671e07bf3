"""Training-data operators: secrets, neighbours, quality, PII, toxicity,
language, tokenisation, packing and near duplicates."""
