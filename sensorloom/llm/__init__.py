"""Operators for training data: archives, filters, near duplicates, decontamination, mixing, token files."""
