"""What plans hold: nothing computed twice."""

import re

from lorewell import queries


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_sections_are_found_once(spark):
    spark.conf.set("spark.sql.maxPlanStringLength", 10**8)
    d = "/root/testdata/sf0.001"
    for query, python in ((queries.c3_headers, 0), (queries.c4_sections, 0), (queries.c6_structure_split, 1)):
        plan = optimized(query(spark, d))
        assert len(re.findall(r"\bsplit\(", plan)) == 1, query.__name__
        assert plan.count("Relation [") == 1 and plan.count("ArrowEvalPython") == python, query.__name__
        assert not re.search(r"Filter .*size\(", plan), query.__name__
    assert not re.search(r"Filter .*size\(", optimized(queries.v5_postings(spark, d)))
