"""Registered queries of the library, by family; each has its SQL twin in ``ORACLES`` where SQL can say it."""

from __future__ import annotations

from . import admission, answers, evaluation, evidence, graph, jobs, lexical, retrieval, structure, temporal

FAMILIES = (lexical, retrieval, temporal, graph, evidence, evaluation, jobs, structure, admission, answers)


def queries() -> dict:
    return {k: v for f in FAMILIES for k, v in f.QUERIES.items()}


def oracles() -> dict:
    return {k: v for f in FAMILIES for k, v in f.ORACLES.items()}
