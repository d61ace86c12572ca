"""Training-data operators: tokens, pages, duplicates, filters, packing, sharding and search.

Nothing else in the library imports this subpackage.
"""
