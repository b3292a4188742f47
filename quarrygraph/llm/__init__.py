"""Training-data operators: packing, personal data, deduplication, decontamination, scoring, archives, token files.

Nothing else in the package imports this subpackage.
"""
