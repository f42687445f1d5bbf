"""Operators for preparing training data: cleaning, de-duplication, decontamination and packing."""
