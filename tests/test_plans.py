"""What plans must look like, whatever they compute."""

import pytest
from codexa.plans import queries as plans

SF = "/root/testdata/sf0.001"


def optimized(spark, name):
    return plans.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_logs_are_parsed_once(spark):
    plan = optimized(spark, "transaction_list")
    assert plan.count("from_json") == 1


@pytest.mark.parametrize("name", ["template_paths", "title_normalize", "calculate_match", "loose_sidecars", "package_identities", "server_answers"])
def test_plans_stay_small(spark, name):
    """Expressions that are named often aren't written out each time."""
    assert len(optimized(spark, name)) < 80_000


def test_scans_read_what_they_need(spark):
    """Columns that a query doesn't use aren't read, and filters reach the files."""
    read = plans.QUERIES["title_normalize"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in read
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in plans.QUERIES["progress_updates"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_no_query_is_a_cross_join_of_tables(spark):
    for name in ("listing_changes", "move_order", "search_pages", "year_proximity"):
        assert "Cartesian" not in plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString(), name


def test_year_proximity_has_every_pair(spark):
    """All pairs of a brand and type, not the nearest few."""
    n = spark.read.parquet(f"{SF}/part.parquet").groupBy("p_brand", "p_type").count().selectExpr("sum(count * (count - 1) div 2)").first()[0]
    got = plans.QUERIES["year_proximity"](spark, SF)
    assert got.count() == got.distinct().count() == n


def test_year_pairs_meet_in_lots(spark):
    """A brand and type of many lots: each pair once, as by a join; one of few parts has one lot."""
    rows = [(i if i % 10 else 5, f"b{i % 3 and 1}", "t", i % 9) for i in range(90)] + [(7, None, "t", 1), (None, "b1", "t", 1), (400, "b1", "t", None)]
    p = spark.createDataFrame(rows, "p_partkey long, p_brand string, p_type string, p_size int")
    got = sorted(tuple(r) for r in plans.year_pairs(p, 4).collect())
    score = lambda x, y: 0.0 if None in (x, y) else next((s for d, s in ((0, 1.0), (2, 0.7), (5, 0.4)) if abs(x - y) <= d), 0.0)
    kept = [r for r in rows if None not in r[:3]]
    assert plans.year_pairs(p, 100)._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_NUM") == 2
    assert got == sorted((x[0], y[0], score(x[3], y[3])) for x in kept for y in kept if x[1:3] == y[1:3] and x[0] < y[0])


def test_whole_pages_are_not_broadcast(spark):
    """A page is far longer than the planner takes a text for."""
    plan = plans.QUERIES["product_pages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    nodes = [line for line in plan.splitlines() if "Join" in line]
    assert nodes and "SortMergeJoin" in nodes[0] and "BroadcastHashJoin" not in nodes[0]


@pytest.mark.parametrize("name", ["account_pages", "search_pages"])
def test_tags_stay_in_their_pages_row(spark, name):
    """Lines are shuffled once, and neither pages nor tags are."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan


def test_elements_are_found_in_their_pages_row(spark):
    """No tag is joined with a tag: a page's work stays with its row."""
    plan = plans.QUERIES["page_elements"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Join", "Exchange", "Aggregate", "Window"))


def test_products_are_read_in_their_pages_row(spark):
    """Columns are spread before pages are built; of a page only what is found in it is shuffled and meets the page."""
    plan = plans.QUERIES["product_pages"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("REPARTITION_BY_NUM") == 2 and plan.count("Exchange") == 3 and "Aggregate" not in plan


def test_names_are_made_comparable_before_they_meet(spark):
    """A part stands in many orders; above the joins nothing is normalised."""
    lines = optimized(spark, "calculate_match").splitlines()
    above = lines[: next(i for i, line in enumerate(lines) if "Join" in line)]
    assert any("author_keys" in line for line in above) and not any("_folded" in line or "regexp_replace" in line for line in above)
