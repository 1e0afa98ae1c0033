"""All queries of the library but those of the training-data pipeline."""

from __future__ import annotations

import sparkloom.functions.scalars
import sparkloom.functions.user
import sparkloom.operators.recipes
import sparkloom.operators.relational
import sparkloom.sources.formats
import sparkloom.streaming.events  # noqa: F401
from sparkloom.plans.registry import ORACLES, QUERIES, sql_query

sql_query(
    "revenue_by_priority",
    "SELECT o_orderpriority, cast(sum(cast(l_extendedprice * (1 - l_discount) AS decimal(18,4))) AS double) AS revenue, count(*) AS n FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE o_orderdate >= timestamp_ntz'1996-01-01' AND o_orderdate < timestamp_ntz'1997-01-01' GROUP BY o_orderpriority",
    "SELECT o_orderpriority, sum((l_extendedprice * (1 - l_discount))::DECIMAL(18,4))::DOUBLE AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY o_orderpriority",
)

__all__ = ["ORACLES", "QUERIES"]
