"""Training-data operators: language ID, mixing, dedup, decontamination, licences, token files, LM scoring."""
