"""Work that takes long for each row comes behind the shuffle that deals rows over tasks."""

import plumbline.queries_tables  # noqa: F401  adds its queries
import pytest
from plumbline.queries import QUERIES
from plumbline.sources.scratch import settled

DATA = "/root/testdata/sf0.001"


def below(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1, plan
    return plan.split("RepartitionByExpression")


@pytest.mark.parametrize("name", ["cleaned_reference", "issues_of_rows", "drop_reasons", "address_fragments", "sanitizer_reasons", "issue_codes_summary"])
def test_rules_are_asked_behind_the_shuffle(spark, name):
    above, under = below(QUERIES[name](spark, DATA))
    assert "RLIKE" in above.upper() and "RLIKE" not in under.upper() and "_told_houses" not in under


def test_issue_samples_asks_once(spark, monkeypatch):
    from plumbline.operators import sanitize

    written = []
    monkeypatch.setattr(sanitize, "settled", lambda df, label: written.append(df) or settled(df, label))
    plan = QUERIES["issue_samples"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert len(written) == 1 and "RLIKE" not in plan
    assert "RLIKE" not in below(written[0])[1]


def test_observed_values_are_picked_once(spark):
    plan = QUERIES["observed_addresses"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "max(" not in plan and "parquet" in plan


def full_plan(spark, name):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_rules_work_values_out_once(spark):
    """Expressions in a lambda are not shared: what a plan says twice is done twice."""
    from plumbline.queries_tables import _ROW

    plan = full_plan(spark, "drop_reasons")
    assert plan.count("(?U)\\s+") == len(_ROW)  # white space of each slot
    assert plan.count("split(lower(") == 1 and plan.count("split(trim(lower(") == 1, plan  # parts of a house, words of a place


def test_fragments_are_worked_out_once(spark):
    plan = full_plan(spark, "address_fragments")
    assert plan.count("array_distinct(") == 1  # the pieces of a text
    assert plan.count("[^0-9a-zа-я]+") == 1, plan  # the key of a street


def test_texts_of_other_lengths_do_not_go_to_python(spark):
    from plumbline.operators.sanitize import address_fragments
    from pyspark.sql import functions as F

    texts = ["ул. Мира, д. 5", "ул. М 5", "ул. Мира, д. 5 " + "а" * 1186, "ул. Мира, д. 5 " + "а" * 1185, None]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, v string").select("n", address_fragments(F.col("v")).alias("f"))
    asked = rows._jdf.queryExecution().optimizedPlan().toString().split("_told_houses(")[1]
    assert asked.startswith("regexp_replace(CASE WHEN"), asked
    assert [r.f for r in rows.orderBy("n").collect()] == [["ул. Мира, д. 5"], [], [], [], []]
