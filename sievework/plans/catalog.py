"""All queries over the driver's tables, with their SQL oracles."""

from __future__ import annotations

from sievework.plans import assets, augmenting, duplicates

QUERIES: dict = {}
ORACLES: dict = {}

for part in (assets, duplicates, augmenting):
    QUERIES.update(part.QUERIES)
    ORACLES.update(part.ORACLES)


def flagship(spark, sf_dir):
    return QUERIES["curation_pipeline"](spark, sf_dir)
