"""Training-data operators: dedup, filters, extraction, packing and token counts.

Nothing outside this subpackage imports it.
"""
