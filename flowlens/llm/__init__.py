"""Training-data operators: scoring, filtering, mixing, packing and near-duplicate joins over text tables.

Nothing else in the library imports this subpackage.
"""
