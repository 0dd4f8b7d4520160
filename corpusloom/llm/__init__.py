"""Training-data operators: secrets, decontamination, licences, near-duplicates, repeats, token files, quality, packing, toxicity."""
