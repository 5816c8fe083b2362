"""Training-data operators: deduplication, cleaning, scans, scoring and mixing of documents.

Nothing else in the library imports this subpackage.
"""
