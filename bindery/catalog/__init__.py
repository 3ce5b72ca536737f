"""Registered queries: name -> (Spark callable, SQL twin or None)."""
from . import corpora, keyed, pairs, scalars

CATALOG = {**corpora.QUERIES, **scalars.QUERIES, **keyed.QUERIES, **pairs.QUERIES}
