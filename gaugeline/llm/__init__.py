"""Training-data operators: deduplication, filtering, scanning, encoding, archiving.

Nothing outside this subpackage imports it.
"""
