"""Training-data operators: search, decontamination, dedup, classifiers, mixing and sharding.

Nothing outside this subpackage imports it; ``queries.QUERIES`` and ``queries.ORACLE_SQL`` list its registered queries.
"""
