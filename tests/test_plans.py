"""Plan checks: no Python UDF in any registered query (the model's: tests/test_model.py), pruned scans, pushed filters, windows."""

import pytest

from receivables.operators import reports
from receivables.plans import catalog
from receivables.sources.fixtures import Fixtures

from conftest import SF_SMALL

MODEL_QUERIES = {"model_metrics", "model_cv", "feature_importance", "model_scores", "predicted_payment"}


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.load_all()) - MODEL_QUERIES))
def test_no_python_udf(spark, name):
    text = plan_text(catalog.run(name, spark, SF_SMALL))
    for marker in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "FlatMapGroupsInPandas", "MapInPandas"):
        assert marker not in text, f"{name} runs Python: {marker}"


def test_scan_prunes_columns(spark):
    text = plan_text(catalog.run("aging_summary", spark, SF_SMALL))
    scan = [line for line in text.splitlines() if "FileScan parquet" in line and "orders" in line]
    assert scan, text
    # Only the order columns the invoice view needs for this query reach the reader.
    assert "o_orderpriority" not in scan[0]


@pytest.fixture(scope="module")
def receivables_parquet(spark, tmp_path_factory):
    """Invoices and payments as parquet, as the operators find them in production."""
    folder = str(tmp_path_factory.mktemp("receivables"))
    fx = Fixtures(spark, SF_SMALL)
    for name in ("invoices", "payments"):
        fx.table(name).write.parquet(f"{folder}/{name}.parquet")
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in ("invoices", "payments")}


def test_operator_filter_and_columns_reach_the_scan(receivables_parquet):
    text = plan_text(reports.top_customers_ar(receivables_parquet["invoices"]))
    assert "EqualTo(status,open)" in text and "PushedFilters: [" in text
    scan = next(line for line in text.splitlines() if "FileScan parquet" in line)
    assert "issue_date" not in scan and "due_date" not in scan


def test_monte_carlo_never_shuffles_the_expanded_rows(spark, receivables_parquet):
    df = catalog.run("cash_scenarios", spark, SF_SMALL)
    text = plan_text(df)
    # Scenario expansion is a broadcast nested loop join over the pruned invoices (the scenario axis and the one-row
    # payment pattern are the broadcast sides).
    assert "BroadcastNestedLoopJoin" in text
    assert "CartesianProduct" not in text
    # Above the expansion there is one exchange: the partial sums per scenario (and the sort of the result).
    above = text[: text.index("BroadcastNestedLoopJoin")]
    exchanges = [line for line in above.splitlines() if "Exchange " in line and "Broadcast" not in line]
    assert 1 <= len(exchanges) <= 2 and "partial_" in above.split("Exchange")[-1]


@pytest.mark.parametrize("name", sorted(set(catalog.load_all()) - MODEL_QUERIES))
def test_no_unpartitioned_window_over_facts(spark, name):
    """A window without partition keys gathers all its rows in one task; only over aggregated or calendar rows."""
    plan = catalog.run(name, spark, SF_SMALL)._jdf.queryExecution().optimizedPlan()

    def walk(node):
        if node.nodeName() == "Window" and node.partitionSpec().isEmpty():
            assert bounded(node.child()), f"{name}: {node.toString()[:300]}"
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    def bounded(node):
        """An aggregate, a generated sequence or a literal table lies between the window and any scan."""
        if node.nodeName() in ("Aggregate", "Range", "LocalRelation", "OneRowRelation"):
            return True
        children = node.children()
        return children.size() > 0 and all(bounded(children.apply(i)) for i in range(children.size()))

    walk(plan)


# Scans and shuffles of the physical plan, at most: a change that reads a table again or shuffles once more shows here.
LIMITS = {
    "audit_export": (9, 5), "dq_summary": (23, 14), "risk_scores": (13, 22), "weekly_plan": (13, 27), "features": (11, 14), "history_at_issue": (4, 5),
    "aging_daily": (3, 6), "aging_trend": (2, 5), "outreach_messages": (17, 23), "success_by_ranges": (10, 19), "customer_history": (2, 1),
    "ar_summary": (3, 2), "top_recommendations": (15, 23), "daily_success_metrics": (3, 2),
}


@pytest.mark.parametrize("name", sorted(LIMITS))
def test_scans_and_shuffles(spark, name):
    text = plan_text(catalog.run(name, spark, SF_SMALL))
    scans, shuffles = text.count("FileScan parquet"), text.count(" Exchange ")
    assert scans <= LIMITS[name][0] and shuffles <= LIMITS[name][1], (scans, shuffles)
