"""Training-data operators: classification, sanitising, formatting, dedup, mixing, packing and output.

Nothing else in the library imports this subpackage.
"""
