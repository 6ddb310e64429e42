"""What the optimiser makes of the queries."""

import pytest

from verisect.plans import ranking, registry, relational

DIR = "/root/testdata/sf0.001"
NAMES = [n for n in registry.QUERIES if n in vars(relational) or n in vars(ranking)]
#: Range joins with a rule table of a few rows, which is broadcast behind a count.
RULE_TABLES = {"j9_interpolation", "l3_systematic_sample"}


def plan(spark, name):
    return registry.QUERIES[name](spark, DIR)._jdf.queryExecution().toString().partition("== Physical Plan ==")[2]


@pytest.mark.parametrize("name", NAMES)
def test_no_products_and_no_python_rows(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BatchEvalPython" not in text
    assert "BroadcastNestedLoopJoin" not in text or name in RULE_TABLES


@pytest.mark.parametrize(
    ("name", "pushed", "columns"),
    [
        ("f1_null_equality_like", "EqualTo(lang,en)", "doc_id:bigint,text:string,lang:string"),
        ("sc3_scan_with_pushed_filter", "EqualTo(o_orderstatus,F)", "o_orderkey:bigint,o_orderstatus:string,o_totalprice:double"),
        ("a8_composite_counts", None, "lang:string,source:string"),
        ("f2_string_cutoff", "LessThanOrEqual(c_name,Customer#000000150)", "c_custkey:bigint,c_name:string"),
    ],
)
def test_filters_and_columns_reach_the_scan(spark, name, pushed, columns):
    text = registry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert f"struct<{columns}>" in text
    assert pushed is None or pushed in text


def test_top_k_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "w1_best_per_group")
    assert "WindowGroupLimit" in plan(spark, "l9_seeded_sample_in_group")


def test_pairing_arms_takes_one_exchange_of_the_pairs(spark):
    assert plan(spark, "j7_paired_delta").count("Exchange hashpartitioning(model#") <= 3


@pytest.mark.parametrize("name", ["a13_frequency_map", "w2_gaps_and_islands", "l8_stratified_sample", "a20_floor_percentile", "j11_nearest_page_before"])
def test_partitions_do_not_change_results(spark, name):
    results = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        results.append(sorted(map(str, registry.QUERIES[name](spark, DIR).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
