"""Training-data operators: fingerprints, deduplication, decontamination, filtering, tokenising, scoring, archives."""
