"""Operators for preparing training corpora: near-duplicates, quality,
decontamination, extraction, URL rules, archives, token files, packing.

Nothing else in the library imports this subpackage.
"""
