"""Training-data operators: dedup, toxicity, tokenising, decontamination, archives, licences."""
