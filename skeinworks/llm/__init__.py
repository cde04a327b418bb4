"""Training-data operators: language, quality, duplicates, tokens, packing, pages.

Nothing outside this subpackage imports it.
"""
