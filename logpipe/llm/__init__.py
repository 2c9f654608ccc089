"""Training-data operators: deduplication, counting, scoring, packing and search.

Every operator takes and returns DataFrames and is usable on its own; the thin
``opN_*`` queries in ``queries.py`` bind them to the driver's tables.
"""
