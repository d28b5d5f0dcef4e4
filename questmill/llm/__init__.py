"""Training-data operators: deduplication, filters, language models, tokens and packing.

Nothing outside this subpackage imports it.
"""
