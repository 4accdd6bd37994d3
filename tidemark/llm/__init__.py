"""Training-data operators: fingerprints, search, filters, tokenisation, classification, extraction and dedup.

Nothing else in the package imports this subpackage; it can be removed without touching the rest.
"""
