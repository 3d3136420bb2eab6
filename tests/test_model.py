"""Late-payment model (ML-1..ML-8): training end to end with both classifiers, folds, scores and persistence."""

import datetime as dt
import glob
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from receivables.functions.stored import Run, workers_find_package
from receivables.operators import boosting, boosting_rows, features, model
from receivables.operators.features import FEATURE_COLUMNS
from receivables.plans.catalog import AS_OF
from receivables.sources.fixtures import Fixtures

from conftest import SF_SMALL


@pytest.fixture(scope="module")
def fx(spark):
    return Fixtures(spark, SF_SMALL)


@pytest.mark.parametrize("kind, params", [("gradient_boost", {"n_estimators": 4}), ("logistic", {"max_iter": 10})])
def test_train_score_and_repeat(fx, kind, params):
    made = [model.train(fx.invoices, fx.customers, fx.payments, AS_OF, kind, cv_folds=3, trained_at=dt.datetime(2024, 1, 1), **params) for _ in range(2)]
    m = made[0].metrics.first()
    assert m.model_type == kind and m.train_samples > m.test_samples > 0 and m.trained_at == dt.datetime(2024, 1, 1)
    assert all(0.0 <= x <= 1.0 for x in (m.train_accuracy, m.test_accuracy, m.cv_roc_auc_mean)) and 0 <= m.cv_roc_auc_std < 0.5
    assert 0 < m.late_rate < 100
    first, again = (t.importances.collect() for t in made)
    assert first == again and made[1].metrics.first() == m
    assert {r.feature for r in first} == set(FEATURE_COLUMNS) and all(r.importance >= 0 for r in first)
    if kind == "gradient_boost":
        assert abs(sum(r.importance for r in first) - 1) < 1e-6
    scores = model.score_open_invoices(made[0].model, fx.invoices, fx.customers, fx.payments, AS_OF)
    rows = scores.collect()
    assert sorted(r.invoice_id for r in rows) == sorted(r.invoice_id for r in fx.invoices.where("status = 'open'").collect())
    assert all(0 <= r.p_late <= 1 and 0 <= r.risk_score <= 100 for r in rows)
    text = scores._jdf.queryExecution().executedPlan().toString()
    assert not any(x in text for x in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow"))
    dates = model.predict_payment_date(scores).collect()
    assert all(r.predicted_payment_date == r.due_date + dt.timedelta(days=int(r.p_late * 45)) for r in dates)


def test_too_few_rows(fx):
    few = fx.invoices.orderBy("invoice_id").limit(20)
    with pytest.raises(ValueError, match="Insufficient training data"):
        model.train(few, fx.customers, fx.payments.limit(0), AS_OF)


def test_folds_differ_by_one_row_at_most(spark, monkeypatch):
    monkeypatch.setattr(model, "FOLD_BUCKET_ROWS", 50)
    rows = spark.range(733).select(F.concat(F.lit("I"), F.col("id")).alias("invoice_id"), (F.col("id") % 7 == 0).cast("int").alias("is_late"))
    folds = model.stratified_folds(rows, 5, 733)
    sizes = {(r.is_late, r.fold): r["count"] for r in folds.groupBy("is_late", "fold").count().collect()}
    for c in (0, 1):
        per = [sizes[c, f] for f in range(5)]
        assert max(per) - min(per) <= 1 and sum(per) == rows.where(F.col("is_late") == c).count()
    again = model.stratified_folds(rows.repartition(7), 5, 733)
    assert {(r.invoice_id, r.fold) for r in folds.collect()} == {(r.invoice_id, r.fold) for r in again.collect()}
    assert model.stratified_folds(rows.limit(0), 5, 0).count() == 0


def test_penalty_is_one_over_n():
    assert model.logistic(250).getRegParam() == 1 / 250
    assert boosting.Settings().n_estimators == 100


def test_training_rows_are_read_from_a_table(fx, monkeypatch):
    """The plan that every fold and tree reads is a scan, whatever the features cost."""
    seen = []

    def stop(train_rows, test_rows, *_):
        seen.extend(len(df._jdf.queryExecution().toString()) for df in (train_rows, test_rows))
        raise KeyboardInterrupt

    monkeypatch.setattr(model, "fit_boosting", stop)
    with pytest.raises(KeyboardInterrupt):
        model.train(fx.invoices, fx.customers, fx.payments, AS_OF)
    assert max(seen) < 10_000


N, COLUMNS = 300, ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def made(spark):
    """Rows with ties, a constant feature, a flag and a label that depends on two features."""
    workers_find_package(spark)
    rng = np.random.default_rng(4)
    rows = []
    for i in range(N):
        a, b = int(rng.integers(0, 20)) / 2, float(rng.random() < 0.3)
        y = int(rng.random() < 1 / (1 + math.exp(-(a - 5 + 3 * b))))
        rows.append((a, b, 1.5, float(rng.integers(-6, 6)), y, i % 3, int(rng.integers(-2**62, 2**62))))
    return rows, spark.createDataFrame(rows, "a double, b double, c double, d double, label int, fold int, draw long").repartition(3)


def grown(spark, rows, settings):
    with Run(spark, "test") as run:
        final, folds, margins = boosting.fit(rows, COLUMNS, 3, settings, run)
        return final, folds, margins.collect()


def plain(rows, leave_out, settings):
    """Boosting by a loop over rows, features and cuts; sums in the units of the library."""
    mine = [r for r in rows if r[5] != leave_out]
    cuts = [sorted({r[f] for r in rows}) for f in range(4)]
    p = sum(r[4] for r in mine) / len(mine)
    margin = {id(r): math.log(p / (1 - p)) for r in rows}
    trees = []
    for t in range(settings.n_estimators):
        on = boosting.sampled(np.array([r[6] for r in mine], np.int64).view(np.uint64), t, settings.seed, settings.subsample)
        taken = [r for r, o in zip(mine, on, strict=True) if o]
        prob = {i: 1 / (1 + np.exp(-m)) for i, m in margin.items()}
        g = {id(r): int(np.rint((r[4] - prob[id(r)]) * 2**30)) for r in rows}
        h = {id(r): int(np.rint(prob[id(r)] * (1 - prob[id(r)]) * 2**20)) for r in rows}
        tree = boosting.Tree.empty(settings.max_depth)

        def value(members, g=g, h=h):
            return settings.learning_rate * (sum(g[id(r)] for r in members) / 2**30) / (sum(h[id(r)] for r in members) / 2**20)

        def split(node, members, level, tree=tree, g=g):
            tree.value[node] = value(members)
            if level == settings.max_depth or len(members) < settings.min_samples_split:
                return
            best = (0.0, None)
            for f in range(4):
                for c in cuts[f]:
                    left, right = [r for r in members if r[f] <= c], [r for r in members if r[f] > c]
                    if min(len(left), len(right)) >= settings.min_samples_leaf:
                        d = float(sum(g[id(r)] for r in left)) / len(left) - float(sum(g[id(r)] for r in right)) / len(right)
                        gain = float(len(left)) * len(right) * d**2 / len(members)
                        if gain > best[0]:
                            best = (gain, (f, c, left, right))
            if best[1]:
                f, c, left, right = best[1]
                tree.feature[node], tree.cut[node] = f, c
                split(2 * node + 1, left, level + 1)
                split(2 * node + 2, right, level + 1)

        split(0, taken, 0)
        trees.append(tree)
        for r in rows:
            margin[id(r)] += walked(tree, r)
    return trees, [margin[id(r)] for r in rows]


def walked(tree, row):
    node = 0
    while tree.feature[node] >= 0:
        node = 2 * node + 1 + (row[tree.feature[node]] > tree.cut[node])
    return tree.value[node]


SMALL = boosting.Settings(n_estimators=4, max_depth=3, min_samples_leaf=5, min_samples_split=12, bins=64)


def test_trees_equal_a_plain_loop(spark, made):
    rows, df = made
    final, folds, margins = grown(spark, df, SMALL)
    for m, fitted in enumerate([*folds, final]):
        trees, margin = plain(rows, m, SMALL)
        for got, want in zip(fitted.trees, trees, strict=True):
            assert got.feature == want.feature
            assert got.cut == want.cut and np.allclose(got.value, want.value, rtol=1e-12)
        seen = [r.margin if m == 3 else r.cv_margin for r in margins if (m == 3 or r.fold == m) and (r.margin if m == 3 else r.cv_margin) is not None]
        assert np.allclose(sorted(seen), sorted(x for x, r in zip(margin, rows, strict=True) if m == 3 or r[5] == m), rtol=1e-9)
    # The expression scores as a walk through the trees does.
    got = df.select(*COLUMNS, final.margin().alias("m"), final.probability().alias("p")).collect()
    for r in got:
        want = final.prior + sum(walked(t, r) for t in final.trees)
        assert r.m == pytest.approx(want, rel=1e-12) and r.p == pytest.approx(1 / (1 + math.exp(-want)), rel=1e-12)
    assert sum(final.importances()) == pytest.approx(1) and final.importances()[2] == 0


def test_levels_over_all_partitions_give_the_same_trees(spark, made, monkeypatch):
    """Broadcast blocks, one job per level, and sums added up on executors first."""
    _, df = made
    settings = boosting.Settings(n_estimators=12, max_depth=3, min_samples_leaf=5, bins=16)
    first = grown(spark, df, settings)
    monkeypatch.setattr(boosting, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(boosting, "TASK_ROWS", 64)
    for direct in (32, 1):
        monkeypatch.setattr(boosting, "MOST_DIRECT", direct)
        again = grown(spark, df, settings)
        assert [m.to_json() for m in (again[0], *again[1])] == [m.to_json() for m in (first[0], *first[1])]
        for c in ("cv_margin", "margin"):
            assert sorted(r[c] for r in again[2] if r[c] is not None) == sorted(r[c] for r in first[2] if r[c] is not None)


def test_auc_of_the_folds_is_exact(spark, made):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    _, df = made
    with Run(spark, "test") as run:
        _, _, margins = boosting.fit(df, COLUMNS, 3, SMALL, run)
        rows = [(r.label, r.cv_margin) for r in margins.collect() if r.fold == 0 and r.cv_margin is not None]
        curve = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol="cv_margin", numBins=0)
        got = curve.evaluate(margins.where("fold = 0 and cv_margin is not null"))
    pairs = [(a > b) + (a == b) / 2 for y, a in rows if y for z, b in rows if not z]
    assert got == pytest.approx(sum(pairs) / len(pairs))


def test_save_and_load(spark, scratch):
    rows = [tuple([float((i * 7 + j) % 13) for j in range(len(FEATURE_COLUMNS))] + [i % 2]) for i in range(80)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in FEATURE_COLUMNS) + ", is_late int")
    prep = model.preparation().fit(df)
    pipeline = model.PipelineModel(stages=[*prep.stages, model.logistic(80, max_iter=20).fit(prep.transform(df))])
    tree = boosting.Tree([3, -1, -1], [0, 0, 0], [5.0, 0.0, 0.0], [0.0, -0.25, 0.5])
    trees = boosting.BoostedTrees(FEATURE_COLUMNS, 0.125, 1, [tree, tree], [0.0] * len(FEATURE_COLUMNS))
    for n, m in enumerate((pipeline, trees)):
        model.save(spark, m, f"{scratch}/model{n}")
        back = model.load(spark, f"{scratch}/model{n}")
        assert type(back) is type(m)
        a = [r.p_late for r in model.predict_proba(m, df).collect()]
        assert a == [r.p_late for r in model.predict_proba(back, df).collect()] and len(set(a)) > 1


def test_blocks_are_filled_and_features_counted_in_bundles(spark, made):
    """Spark's small batches make full blocks; a bundle's sums are those of its features."""
    _, df = made
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        with Run(spark, "test") as run:
            packed = boosting.blocks(df.coalesce(1), COLUMNS, boosting.cut_points(df, COLUMNS, 64), 128, run).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(len(r.y) for r in packed) == [N % 128, 128, 128]
    widths = [64, 64, 64, 13, 13, 8, 3, 3, 2, 1]
    bundles = boosting.bundled(widths)
    assert sorted(f for b in bundles for f in b) == list(range(len(widths))) and len(bundles) < len(widths) / 2
    assert all(math.prod(widths[f] for f in b) <= boosting.BUNDLE_CELLS for b in bundles)
    rng = np.random.default_rng(1)
    x = np.stack([rng.integers(0, w, 500) for w in widths]).astype(np.uint8)
    g, h = rng.integers(-(2**30), 2**30, (1, 500)).astype(np.int32), rng.integers(0, 2**18, (1, 500)).astype(np.int32)
    block = boosting.Sampled(x, rng.random((1, 500)) < 0.8, g, h)
    root = np.array([0, -1, -1]), np.array([20, 0, 0])
    for levels, nodes in ((0, [0]), (1, [2]), (1, [1, 2])):
        found = next(boosting.level_sums(iter([block]), [root], [nodes], levels, widths))[0]
        for j, node in enumerate(nodes):
            mine = block.on[0] & (np.ones(500, bool) if levels == 0 else (x[0] > 20) == (node == 2))
            want = [[sum(v[0][mine & (x[f] == b)].astype(int)) for f, w in enumerate(widths) for b in range(w)] for v in (g, h, np.ones((1, 500)))]
            assert [part[j].tolist() for part in found] == want


def test_margin_walks_only_a_rows_path(spark):
    """Scores are nested conditions, not look-ups of tree arrays; values over a cut, missing and not finite ones go their way."""
    tree = boosting.Tree([0, 1, -1, -1, -1, -1, -1], [0] * 7, [1e-7, -2.5] + [0.0] * 5, [0.0, 0.0, 1e22, -1e-9, 0.3, 0.0, 0.0])
    fitted = boosting.BoostedTrees(["a", "odd `name"], -0.25, 2, [tree, tree])
    rows = spark.createDataFrame([(1.0, 0.0), (None, None), (0.0, -2.5), (float("nan"), 0.0), (1e-7, float("-inf"))], "a double, `odd ``name` double")
    got = [r.m for r in rows.select(fitted.margin().alias("m")).collect()]
    assert got == [-0.25 + 1e22 + 1e22, -0.25 + 0.3 + 0.3, -0.25 - 1e-9 - 1e-9, -0.25 + 1e22 + 1e22, -0.25 - 1e-9 - 1e-9]
    assert "from_json" not in rows.select(fitted.margin())._jdf.queryExecution().toString()
    assert spark.range(1).select(boosting.BoostedTrees(["id"], 0.5, 2, []).margin()).first()[0] == 0.5


def test_rows_in_growth_take_no_storage_and_can_be_lost(spark, made, monkeypatch):
    """Levels read no cached rows; files that vanish, or stop in the middle of a step, are built anew and give the same trees."""
    _, df = made
    settings = boosting.Settings(n_estimators=5, max_depth=3, min_samples_leaf=5, bins=16)
    first = grown(spark, df, settings)
    monkeypatch.setattr(boosting, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(boosting, "TASK_ROWS", 64)
    stored, calls, grow = [], [], boosting.grow_level_by_level

    def watched(totals, *args):
        def lossy(**k):
            out = totals(**k)
            stored.append(sum(i.memSize() + i.diskSize() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()))
            calls.append(k["levels"])
            for n, part in enumerate(sorted(glob.glob(f"{locals_of(spark)}/python/boosting-*/[0-9]"))):
                if (len(calls) + n) % 4 == 0:
                    os.remove(part)
                elif (len(calls) + n) % 4 == 1:
                    np.memmap(part, np.int64, "r+")[0] = -1
            return out

        return grow(lossy, *args)

    monkeypatch.setattr(boosting, "grow_level_by_level", watched)
    again = grown(spark, df, settings)
    assert len(calls) == 15 and max(stored) < 4096  # places of partitions; the margins of 300 rows and 4 models alone are 9,600 bytes
    assert [m.to_json() for m in (again[0], *again[1])] == [m.to_json() for m in (first[0], *first[1])]
    assert sorted(r.margin for r in again[2] if r.margin is not None) == sorted(r.margin for r in first[2] if r.margin is not None)
    assert not glob.glob(f"{locals_of(spark)}/python/boosting-*")


def locals_of(spark):
    """Spark's own local folder, where the tasks keep their rows."""
    return spark.sparkContext.parallelize([0], 1).map(lambda _: os.environ["SPARK_LOCAL_DIRS"]).first()


def test_blocks_are_dealt_in_runs(spark, scratch):
    rows = [(bytes(n),) for n in (7, 5, 9, 1, 8, 6, 4)]
    spark.createDataFrame(rows, "y binary").repartition(3).write.parquet(f"{scratch}/blocks")
    packed = spark.read.parquet(f"{scratch}/blocks")
    for tasks in (1, 3, 20):
        parts = boosting.dealt(packed, tasks)
        assert [p.number for p in parts] == list(range(len(parts))) and sum(p.rows for p in parts) == 40 and len(parts) <= tasks
        found = [[len(b["y"]) for b in boosting_rows.stored_blocks(p)] for p in parts]
        assert [sum(f) for f in found] == [p.rows for p in parts] and sorted(sum(found, [])) == sorted(len(y) for y, in rows)
        assert max(p.rows for p in parts) <= 40 / tasks + 2 * 9


def test_trees_are_compiled_not_interpreted(spark):
    """Spark interprets what stands in a lambda function: no condition of a tree does."""
    tree = boosting.Tree([0, 0, -1, -1, -1, -1, -1], [0] * 7, [0.5, -0.5] + [0.0] * 5, [0.0, 0.0, 1.0, 2.0, 3.0, 0.0, 0.0])
    rows = spark.createDataFrame([(1.0,), (0.0,), (-1.0,)], "a double")
    lambdas = []
    for n in (1, 40):
        scored = rows.select(boosting.BoostedTrees(["a"], 0.25, 2, [tree] * n).margin().alias("m"))
        assert [r.m for r in scored.collect()] == [0.25 + n, 0.25 + 3 * n, 0.25 + 2 * n]
        lambdas.append(scored._jdf.queryExecution().analyzed().toString().count("lambda"))
    assert lambdas[0] == lambdas[1]


def test_training_joins_once_and_writes_features_once(fx, monkeypatch):
    """Invoices and payments meet in one stored table; features are written once, everything after them is bytes."""
    written, stored = {}, Run.stored

    def watched(self, df, name):
        written[name] = df.columns
        return stored(self, df, name)

    monkeypatch.setattr(Run, "stored", watched)
    model.train(fx.invoices, fx.customers, fx.payments, AS_OF, cv_folds=3, n_estimators=1, max_depth=2)
    assert {"paid", "customers", "frame", "blocks"} <= set(written)
    assert [n for n, columns in written.items() if set(FEATURE_COLUMNS) <= set(columns)] == ["frame"]


@pytest.mark.parametrize("point_in_time", [False, True])
def test_features_from_stored_sums_are_the_same(spark, point_in_time):
    """Customers without known rows, missing and unknown customers, missing dates, repeated keys."""
    d = dt.date
    invoices = spark.createDataFrame(
        [("i1", "a", d(2001, 1, 1), d(2001, 2, 1), 100.0, "open", "recurring", "online"), ("i2", "a", d(2001, 3, 1), d(2001, 4, 1), 50.5, "paid", "one_time", "offline"),
         ("i3", "b", d(2001, 8, 1), d(2001, 9, 1), 70.0, "open", "milestone", "online"), ("i4", None, d(2001, 2, 1), d(2001, 3, 1), 30.0, "open", None, None),
         ("i5", "c", None, d(2001, 3, 1), 20.0, None, "recurring", "online"), ("i5", "c", d(2001, 1, 5), None, 25.0, "open", "recurring", "online"), ("i6", "zz", d(2001, 1, 9), d(2001, 1, 19), 1.0, "paid", "one_time", "online")],
        "invoice_id string, customer_id string, issue_date date, due_date date, invoice_amount double, status string, invoice_type string, channel string")
    customers = spark.createDataFrame([("a", 30, 1000.0), ("b", 15, 0.0), ("b", 45, 10.0), ("c", 30, None), ("d", 30, 5.0), (None, 1, 1.0)], "customer_id string, payment_terms_days int, credit_limit double")
    payments = spark.createDataFrame([("i1", d(2001, 2, 20), 40.0), ("i1", d(2001, 7, 20), 60.0), ("i2", d(2001, 3, 30), 50.5), ("i4", None, 3.0), ("i5", d(2001, 2, 2), None), (None, d(2001, 1, 1), 9.0)],
                                     "invoice_id string, payment_date date, amount double")
    labelled = features.late_target(invoices, payments, 7).drop("payment_date", "days_late")
    want = features.engineer_features(labelled, customers, payments, AS_OF, history_invoices=invoices, point_in_time=point_in_time)
    columns = ["invoice_id", "issue_date", "is_late", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in FEATURE_COLUMNS]]
    with Run(spark, "test") as run:
        got = model.training_frame(invoices, customers, payments, AS_OF, 7, point_in_time, run)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*columns).collect()))
