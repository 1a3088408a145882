"""Training-data operators: language id, sharding, HTML text, quality, packing, repeats,
personal data, decontamination, exact and near duplicates.

Nothing outside this subpackage imports it.
"""
