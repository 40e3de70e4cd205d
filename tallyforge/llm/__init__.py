"""Training-data operators: deduplication, filters, scans, extraction and encoding of large corpora.

Nothing else in the package imports this subpackage.
"""
