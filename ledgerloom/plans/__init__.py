"""Queries over the given tables, with their SQL twins."""

from ledgerloom.plans import features, feeds, labels, roundtrips, scoring, streams, synthesis  # noqa: F401  (they register their queries)
from ledgerloom.plans.registry import QUERIES, TWINS


def all_queries() -> dict:
    return dict(QUERIES)


def all_twins() -> dict[str, str]:
    return dict(TWINS)
