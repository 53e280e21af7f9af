"""Named queries: operators applied to tables, with the SQL that checks them."""

from seqweave.plans import automaton, claims, classes, clusters, counting, hypotheses, inference, nulls, profiles, relations, resampling, retrieval, summaries, vocabulary, zones
from seqweave.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "automaton", "claims", "classes", "clusters", "counting", "hypotheses", "inference", "nulls", "profiles", "relations", "resampling", "retrieval", "summaries", "vocabulary", "zones"]
