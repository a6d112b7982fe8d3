"""Training-data operators: packing, decontamination, deduplication, quality, sharding, counts, licences.

Nothing outside this subpackage imports it; ``queries`` registers its ``opN_`` queries.
"""
