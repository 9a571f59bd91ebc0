"""Training-data operators: near duplicates, secrets, quality, search, tokens, mixing, sharding, licences.

Nothing outside this subpackage imports it.
"""
