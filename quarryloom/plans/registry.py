"""All registered queries and their SQL."""

from quarryloom.operators import asof, chunking, evaluate, evidence, fingerprints, hybrid, learner, queryprep, retrieval, sourcing, store, traces
from quarryloom.plans import sql
from quarryloom.streaming import streams

_AREAS = [asof, chunking, evaluate, evidence, fingerprints, hybrid, learner, queryprep, retrieval, sourcing, store, traces, sql, streams]
QUERIES = {k: v for area in _AREAS for k, v in area.QUERIES.items()}
ORACLE = {k: v for area in _AREAS for k, v in area.ORACLE.items()}
