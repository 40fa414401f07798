"""Declarative cohort description (replaces per-dataset hard-coded encoders)."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class CohortSpec:
    key: str
    target: str
    nominal: list[str] = field(default_factory=list)          # one-hot; trailing '!' = label code
    ordinal: dict[str, list[str]] = field(default_factory=dict)  # column -> ordered levels
    target_ordinal: list[str] | None = None                   # target levels (unknown -> -1)
    numeric: list[str] = field(default_factory=list)          # columns to z-score
    drop: list[str] = field(default_factory=list)
    sensitive: str | None = None
    privileged: object = None


# The order-table cohort used by tests and queries.
ORD_SPEC = CohortSpec(
    key="o_orderkey", target="o_orderstatus",
    nominal=["c_mktsegment"],
    ordinal={"o_orderpriority": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]},
    numeric=["o_totalprice", "c_acctbal", "n_regionkey"],
    sensitive="c_mktsegment", privileged="BUILDING")
