"""Training-data operators: extraction, filtering, deduplication, tokenisation, privacy.

The subpackage stands alone: it imports nothing from the rest of the library
and nothing in the rest of the library imports it.
"""
