"""Registered queries on places of matches."""

from workload import queries

SF = "/root/testdata/sf0.001"


def test_places_of_an_expression_are_found_once(spark):
    plan = queries.match_spans_regex(spark, SF)._jdf.queryExecution().optimizedPlan()
    assert "Join" not in plan.toString()
