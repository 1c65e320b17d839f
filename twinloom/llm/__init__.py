"""Training-data operators: scoring, search, deduplication, mixing, packing and encoding.

Nothing else in the library imports this subpackage. ``queries`` holds the
driver-facing queries; every other module is one operator with its own
general interface.
"""
