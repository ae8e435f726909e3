"""Queries of the ledger operators and their SQL."""

from __future__ import annotations

from orrery.plans import checks, columns, damaged, ingest, reads, stream
from orrery.sources.views import Views, with_clause

_PLANS = reads.PLANS | ingest.PLANS | checks.PLANS | damaged.PLANS | columns.PLANS | stream.PLANS


def _query(plan):
    return lambda spark, sf_dir: plan(Views(spark, sf_dir))


QUERIES = {name: _query(plan) for name, (plan, _) in _PLANS.items()}
ORACLE_SQL = {name: with_clause(sql) for name, (_, sql) in _PLANS.items() if sql}
