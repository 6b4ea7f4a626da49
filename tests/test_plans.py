"""Plan shapes that matter at scale."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_projection_reach_the_scan(spark):
    p = plan(E.queries()["scan_pushdown"](spark, SF))
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,42)]" in p
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in p


def test_row_numbering_is_range_partitioned_not_a_single_window(spark):
    """The rows are range-partitioned and checkpointed; the only single-partition step is
    the offset window over the per-task count table (one row per task)."""
    p = plan(E.queries()["generated_rows"](spark, SF))
    assert "ExistingRDD" in p
    lines = p.splitlines()
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            assert "_q_pid" in " ".join(lines[i:i + 4])


def test_sorted_rows_are_numbered_by_their_outputs(spark):
    """No checkpoint; the only single-partition step is the running sum over one row per output."""
    p = plan(E.queries()["global_sort"](spark, SF))
    assert "ExistingRDD" not in p and "row_index" in p and p.count("Exchange SinglePartition") == 1
    assert "functions=[count(1)]" in p[p.index("Exchange SinglePartition"):]


def test_the_diamond_scans_once(spark):
    p = plan(E.queries()["diamond"](spark, SF))
    assert p.count("FileScan") == 1 and p.count("Exchange hashpartitioning") == 1


def test_first_match_compares_no_token_with_every_text(spark):
    p = plan(E.queries()["first_match"](spark, SF))
    assert "CartesianProduct" not in p and "NestedLoop" not in p


def test_votes_and_caps_are_limited_per_group_before_the_shuffle(spark):
    for name in ("majority_vote", "cap_per_group"):
        p = plan(E.queries()[name](spark, SF))
        assert "WindowGroupLimit" in p and "Partial" in p and "ExistingRDD" not in p


def test_models_are_ranked_in_one_scoring_pass(spark):
    p = plan(E.queries()["rank_models"](spark, SF))
    assert p.count("Exchange") <= 18 and p.count("Join") <= 5


def test_partial_aggregation_before_exchange(spark):
    p = plan(E.queries()["skewed_group"](spark, SF))
    assert "partial_count" in p and "partial_sum" in p
