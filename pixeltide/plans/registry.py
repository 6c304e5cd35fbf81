"""The registered queries and the SQL that states the same results."""

from __future__ import annotations

from pixeltide.plans import detect_queries, io_queries, pixel_queries, time_queries

GROUPS = [detect_queries, pixel_queries, time_queries, io_queries]
FLAGSHIP = "annotate_detections"


def entry(spark, sf_dir):
    return queries()[FLAGSHIP](spark, sf_dir)


def queries():
    return {k: v for g in GROUPS for k, v in g.Q.items()}


def oracle_sql():
    return {k: v for g in GROUPS for k, v in g.SQL.items()}
