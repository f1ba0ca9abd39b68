"""Training-data operators: extraction, filtering, deduplication, tokenising, scoring.

Each module holds one operator with its own general interface; ``queries``
registers them over the driver's tables. Nothing outside this package imports it.
"""
