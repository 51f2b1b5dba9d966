"""Models without a fit per window, against plain fits in numpy."""

from __future__ import annotations

import datetime
import math
import pathlib

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerline.operators import artifacts, aspects, encoders, features, forecast, models, moments, search, seasonal, sentiment, trees
from ledgerline.operators.trees import boost_windows, ensemble_of, value_bins, vector
from ledgerline.session import cut_lineage, shared_folder

D = datetime.date


def month(i):
    return D(2015 + i // 12, i % 12 + 1, 1)


@pytest.fixture(scope="module")
def panel(spark):
    r = np.random.default_rng(5)
    rows = []
    for k in range(6):
        price = 100.0 + 10 * k
        for i in range(30):
            a, b = float(r.normal()), float(r.integers(0, 5))
            change = 0.05 * (a > 0) - 0.02 * b + 0.01 * float(r.normal())
            rows.append((f"k{k}", month(i), price, a if r.random() > 0.1 else None, b, month(i + 1), price * (1 + change), change if i < 29 else None))
            price = round(price * (1 + change), 3)
    schema = "k string, month_start date, median_price double, a double, b double, target_month_1m date, target_price_1m double, target_change_1m double"
    return spark.createDataFrame(rows, schema)


def plain_boost(x, y, rounds, depth, rate, least):
    """Trees grown one window at a time; returns a function of rows."""
    bins = value_bins(x)
    base, trees, rest = y.mean(), [], y - y.mean()

    def grow(own, level):
        s, n, best = rest[own].sum(), len(own), (0.0,)
        if level == depth:
            return rate * s / n if n else 0.0
        for f in range(x.shape[1]):
            for b in np.unique(bins[own, f]):
                left = own[bins[own, f] <= b]
                if least <= len(left) <= n - least:
                    sl = rest[left].sum()
                    gain = round(sl**2 / len(left) + (s - sl) ** 2 / (n - len(left)) - s**2 / n, 9)
                    if gain > best[0]:
                        best = (gain, f, b)
        if best[0] <= 0:
            return grow(own, depth) if n else 0.0
        _, f, b = best
        go = bins[own, f] <= b
        return f, b, grow(own[go], level + 1), grow(own[~go], level + 1)

    def leaf(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    for _ in range(rounds):
        tree = grow(np.arange(len(y)), 0)
        trees.append(tree)
        rest = rest - np.array([leaf(tree, row) for row in bins])
    return lambda q: np.array([base + sum(leaf(t, row) for t in trees) for row in value_bins(q)])


def rows_of(panel):
    return [r for r in panel.where("target_change_1m is not null").orderBy("k", "month_start").collect()]


def matrix(rows, names):
    return np.array([[math.nan if r[c] is None else r[c] for c in names] for r in rows], float)


NUMERIC = ["a", "b", "median_price"]


def test_backtest_of_all_origins_equals_a_fit_per_origin(spark, panel):
    origins = [month(i) for i in (9, 10, 17, 27)] + [month(0)]
    got = {(r.model_family, r.k, r.origin_month): r for r in forecast.global_backtest(panel, ["k"], NUMERIC, 1, origins, rounds=4, depth=2).collect()}
    rows = rows_of(panel)
    n = {"global": 0, "global_linear": 0}
    for o in origins:
        train = [r for r in rows if r.target_month_1m <= o]
        test = [r for r in rows if r.month_start == o and (o.year - 2015) * 12 + o.month >= 6]
        if len(train) < 2 or not test:
            continue
        trees = plain_boost(matrix(train, NUMERIC), np.array([r.target_change_1m for r in train]), 4, 2, 0.3, 5)
        for r, change in zip(test, trees(matrix(test, NUMERIC)), strict=True):
            found = got["global", r.k, o]
            assert found.predicted == pytest.approx(max(r.median_price * (1 + change), 0), rel=1e-9) and found.actual == r.target_price_1m and found.naive == r.median_price
            n["global"] += 1
        x, y = matrix(train, NUMERIC), np.array([r.target_change_1m for r in train])
        keep = ~np.isnan(x).any(axis=1)
        x, y = x[keep], y[keep]
        z = (x - x.mean(0)) / x.std(0)
        w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
        for r in test:
            if r.a is None:
                assert ("global_linear", r.k, o) not in got
                continue
            change = y.mean() + ((matrix([r], NUMERIC)[0] - x.mean(0)) / x.std(0)) @ w
            assert got["global_linear", r.k, o].predicted == pytest.approx(max(r.median_price * (1 + change), 0), rel=1e-7)
            n["global_linear"] += 1
    assert len(got) == sum(n.values()) and min(n.values()) > 15


def test_backtest_without_origins(panel):
    assert forecast.global_backtest(panel, ["k"], NUMERIC, 1, []).count() == 0


def test_windows_with_their_own_parameters(spark, panel):
    """Candidates by folds and all rows, grown together, equal plain fits."""
    rows = panel.where("target_change_1m is not null").withColumn("fold", F.month("month_start") % 3).cache()
    local = rows.orderBy("k", "month_start").collect()
    fold = np.array([r.fold for r in local])
    one = np.array([[f != w for w in range(3)] + [True] for f in range(3)])
    member = np.concatenate([one, one], axis=1)
    rate, least = np.repeat([0.1, 0.5], 4), np.repeat([3.0, 20.0], 4)
    model = boost_windows(rows, vector(NUMERIC), 3, F.col("target_change_1m"), F.col("fold"), member, 3, 2, rate, least)
    x, y = matrix(local, NUMERIC), np.array([r.target_change_1m for r in local])
    for w in range(8):
        own = member[fold, w]
        want = plain_boost(x[own], y[own], 3, 2, rate[w], least[w])(x)
        assert np.allclose(model.predict(value_bins(x), np.full((len(x), 1), w))[:, 0], want, rtol=1e-9, atol=1e-12)


def test_levels_read_one_row_for_like_rows(spark, panel, monkeypatch):
    """Copies of rows make no more cells, and trees of copies equal plain fits."""
    rows = panel.where("target_change_1m is not null")
    many = rows.crossJoin(spark.range(20)).withColumn("g", F.pmod("id", F.lit(4)))
    read = []
    monkeypatch.setattr(trees, "cut_lineage", lambda df: read.append(cut_lineage(df)) or read[-1])
    model = boost_windows(many, vector(NUMERIC), 3, F.col("target_change_1m"), F.col("g"), np.ones((4, 2), bool), 2, 2, 0.3, np.array([5.0, 40.0]))
    assert sum(r.n for r in read[0].collect()) == many.count() and read[0].count() <= rows.count()
    local = [r for r in rows.collect() for _ in range(20)]
    x, y = matrix(local, NUMERIC), np.array([r.target_change_1m for r in local])
    for w, least in enumerate((5, 40)):
        assert np.allclose(model.predict(value_bins(x), np.full((len(x), 1), w))[:, 0], plain_boost(x, y, 2, 2, 0.3, least)(x), rtol=1e-9, atol=1e-12)


def test_bins_keep_the_order_of_numbers():
    x = np.array([-1e9, -5.0, -1.0, -1e-3, 0.0, 1e-3, 0.5, 1.0, 1.02, 7.0, 1e9])
    bins = value_bins(x)
    assert (np.diff(bins) > 0).all() and value_bins(np.array([np.nan]))[0] < bins[0]


def test_sums_of_products_and_penalties(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 4)) * [1, 10, 0.1, 1] + [0, 50, 2, 0]
    x[:, 3] = 7.0  # does not vary
    y = x[:, 0] - 0.1 * x[:, 1] + r.normal(size=300)
    rows = spark.createDataFrame([(int(i % 3), [float(v) for v in row] + [float(t)]) for i, (row, t) in enumerate(zip(x, y, strict=True))] + [(0, [None, 1.0, 1.0, 1.0, 1.0]), (None, [1.0] * 5)], "g int, x array<double>")
    cells = moments.product_sums(rows, F.col("g"), F.col("x"), 5).collect()
    by = [moments.matrix(((c.i, c.j, c.value) for c in cells if c.g == g), 6) for g in range(3)]
    full = np.column_stack([np.ones(300), x, y])
    for g in range(3):
        assert np.allclose(by[g], full[g::3].T @ full[g::3])
    total = sum(by)
    z = np.column_stack([(x[:, k] - x[:, k].mean()) / (x[:, k].std() or 1) for k in range(4)])
    for penalty in (0.1, 30.0):
        w = np.linalg.solve(z.T @ z + (penalty + 1e-9) * np.eye(4), z.T @ (y - y.mean()))
        got = moments.ridge(total, penalty)
        assert np.allclose(got[0] + x @ got[1:], y.mean() + z @ w)
        assert moments.squared_error(total, got) == pytest.approx(float(((got[0] + x @ got[1:] - y) ** 2).sum()))
    for penalty, l1 in ((0.01, 0.5), (0.3, 0.7)):
        got = moments.elastic_net(total, penalty, l1)
        w = got[1:] * np.array([x[:, k].std() or 1 for k in range(4)])
        slope = z.T @ (y - got[0] - x @ got[1:]) / 300 - penalty * (1 - l1) * w
        assert all(abs(s - penalty * l1 * np.sign(v)) < 1e-7 if v else abs(s) <= penalty * l1 + 1e-7 for s, v in zip(slope[:3], w[:3], strict=True)) and got[4] == 0


def stepwise(model, panel, keys, steps):
    """One step of the fitted pipeline after the other."""
    state = {r[keys[0]]: r.asDict() for r in panel.orderBy("month_start").collect()}
    first = {k: r["median_price"] for k, r in state.items()}
    out = {}
    for step in range(1, steps + 1):
        rows = panel.sparkSession.createDataFrame(list(state.values()), panel.schema)
        for r in model.transform(rows).collect():
            k, before = r[keys[0]], state[r[keys[0]]]
            price = max(before["median_price"] * (1 + r["change"]), 0.0)
            base = before["median_price"] / before["price_index"]
            later = before["month_start"].year * 12 + before["month_start"].month
            state[k] = before | {"median_price": price, "price_lag_1": price, "price_index": price / base, "month_start": D(later // 12, later % 12 + 1, 1), "month": float(later % 12 + 1), "cohort_age_months": before["cohort_age_months"] + 1}
            out[k, step] = (state[k]["month_start"], price, price / first[k] - 1)
    return out


def test_recursive_forecast_equals_step_by_step(spark):
    r = np.random.default_rng(2)
    rows = []
    for k in range(4):
        price = 50.0 + k
        for i in range(20):
            change = 0.03 * math.sin(i) + 0.01 * float(r.normal())
            rows.append((f"k{k}", month(i + k), price, price / 50, None if k == 3 and i > 15 else price * 0.99, float(i), float((i + k) % 12 + 1), change))
            price *= 1 + change
    panel = spark.createDataFrame(rows, "k string, month_start date, median_price double, price_index double, price_lag_1 double, cohort_age_months double, month double, target_change_1m double")
    model = forecast.fit_change_model(panel, ["median_price", "price_lag_1", "cohort_age_months", "month", "price_index"], "target_change_1m")
    want = stepwise(model, panel, ["k"], 3)
    got = {(x.k, x.step): (x.forecast_month, x.predicted_price, x.change_from_observed) for x in forecast.recursive_forecast(model, panel, ["k"], 3).collect()}
    assert got.keys() == want.keys()
    for key, (day, price, change) in want.items():
        assert got[key][0] == day and got[key][1] == pytest.approx(price, rel=1e-12) and got[key][2] == pytest.approx(change, rel=1e-9)
    flat = forecast.fit_change_model(panel.limit(1), ["median_price"], "target_change_1m")
    assert ensemble_of(flat).constant == pytest.approx(rows[0][-1]) or ensemble_of(flat).trees == []
    assert forecast.recursive_forecast(flat, panel, ["k"], 2).count() == 8


def test_frequent_values_have_slots(spark):
    rows = [(v, 0.0) for v, n in {"a": 30, "b": 12, "c": 12, "d": 9, None: 11}.items() for _ in range(n)]
    df = spark.createDataFrame(rows, "v string, y double")
    fit = lambda **p: encoders.FrequentOneHot(inputCol="v", outputCol="o", **p).fit(df)
    assert fit().slots() == ["v=a", "v=b", "v=c", "v=UNKNOWN", "v=(infrequent)"]
    assert fit(mostSlots=3).slots() == ["v=a", "v=b", "v=(infrequent)"]
    assert fit(leastRows=1).slots() == ["v=a", "v=b", "v=c", "v=UNKNOWN", "v=d"]
    assert fit(leastRows=1, mostSlots=5).slots()[-1] == "v=d" and fit(leastRows=1, mostSlots=4).slots() == ["v=a", "v=b", "v=c", "v=(infrequent)"]
    new = spark.createDataFrame([("a",), ("d",), ("new",), (None,)], "v string")
    got = fit().transform(new).select(vector_to_array("o")).collect()
    assert [list(r[0]) for r in got] == [[1, 0, 0, 0, 0], [0, 0, 0, 0, 1], [0, 0, 0, 0, 1], [0, 0, 0, 1, 0]]
    assert [sum(r[0]) for r in fit(leastRows=1).transform(new).select(vector_to_array("o")).collect()] == [1, 1, 0, 1]
    assert encoders.FrequentOneHot(inputCol="v", outputCol="o").fit(df.limit(0)).transform(new).count() == 4


def test_blended_means(spark):
    df = spark.createDataFrame([("a", 1.0)] * 30 + [("b", 4.0)] * 2 + [(None, 2.0), ("c", None)], "v string, y double")
    model = encoders.SigmoidTarget(inputCol="v", outputCol="e", labelCol="y").fit(df)
    prior = (30 + 8 + 2) / 33
    blend = lambda mean, n: prior * (1 - 1 / (1 + math.exp((20 - n) / 10))) + mean / (1 + math.exp((20 - n) / 10))
    got = {r.v: r.e for r in model.transform(spark.createDataFrame([("a",), ("b",), (None,), ("c",), ("new",)], "v string")).collect()}
    assert got == pytest.approx({"a": blend(1, 30), "b": blend(4, 2), None: blend(2, 1), "c": prior, "new": prior})


@pytest.fixture(scope="module")
def cars(spark):
    r = np.random.default_rng(9)
    rows = []
    for i in range(400):
        miles, kind, model = float(r.uniform(0, 1e5)), "ab"[i % 2], f"m{i % 7}"
        rows.append((i // 2, miles if i % 13 else None, kind, model, float(np.exp(10 - miles / 1e5 + 0.3 * (kind == "a") + 0.1 * (i % 7) + 0.05 * r.normal()))))
    return spark.createDataFrame([*rows, (999, 1.0, "a", "m1", None)], "vin long, miles double, kind string, model string, price double")


def test_few_means_leave_rows_in_place(spark):
    rows = spark.range(100).select((F.col("id") % 5).cast("string").alias("v"), F.col("id").cast("double").alias("y"))
    made = encoders.SigmoidTarget(inputCol="v", outputCol="e", labelCol="y").fit(rows).transform(rows)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = made.select("v", "e")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_feature_space_reads_its_frame_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(features, "cut_lineage", lambda df: kept.append(cut_lineage(df)) or kept[-1])
    rows = spark.range(500).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("string").alias("b"), F.col("id").cast("double").alias("label"))
    found = features.feature_space(rows, models.preprocessor(["a"], ["b"]), most_rows=100)
    assert [k.count() for k in kept] == [500, 100] and found["profile_rows"] == 100 and found["training_rows"] == 500


def test_panel_of_the_queries_is_written_once(spark):
    from ledgerline.plans import learning
    from ledgerline.views import Market

    plan = learning._panel(Market(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "lineitem" not in plan and "LogicalRDD" in plan


def test_search_errors_equal_refitting(spark, cars):
    stages = encoders.price_stages(["miles"], ["kind"], ["model"])
    found = search.grouped_search(cars, stages, "price", "vin", ("ridge", "gbt"), most_sets=2)
    rows = cars.where("price is not null").withColumns({"fold": F.pmod(F.xxhash64("vin"), F.lit(3)), "log_label": F.log1p("price")}).cache()
    for family in ("ridge", "gbt"):
        for params, error in found[family].errors:
            own = []
            for f in range(3):
                fitted = Pipeline(stages=stages).fit(rows.where(F.col("fold") != f))
                part = fitted.transform(rows).select("fold", "price", "log_label", vector_to_array("features").alias("x")).collect()
                x, y, fold = np.array([p.x for p in part]), np.array([p.log_label for p in part]), np.array([p.fold for p in part])
                train = fold != f
                if family == "ridge":
                    mean, std = x[train].mean(0), x[train].std(0)
                    std = np.where(std < 1e-9, 1.0, std)
                    z = (x - mean) / std
                    w = np.linalg.solve(z[train].T @ z[train] + params["penalty"] * np.eye(x.shape[1]), z[train].T @ (y[train] - y[train].mean()))
                    guess = y[train].mean() + z @ w
                else:
                    guess = _boosted(x[train], y[train], params)(x)
                price = np.array([p.price for p in part])
                own.append(np.sqrt(np.mean((np.maximum(np.expm1(guess[~train]), 0) - price[~train]) ** 2)))
            assert error == pytest.approx(np.mean(own), rel=1e-6)
        assert found[family].error == min(e for _, e in found[family].errors)


def _boosted(x, y, params):
    bins, trees, rest = value_bins(x), [], y - y.mean()
    rate, least, l2 = params["rate"], params["least_rows"], params["l2"]

    def grow(own, level):
        s, n, best = rest[own].sum(), len(own), (0.0,)
        if level == search.DEPTH:
            return rate * s / (n + l2) if n else 0.0
        for f in range(x.shape[1]):
            for b in np.unique(bins[own, f]):
                left = own[bins[own, f] <= b]
                if least <= len(left) <= n - least:
                    sl = rest[left].sum()
                    gain = round(sl**2 / (len(left) + l2) + (s - sl) ** 2 / (n - len(left) + l2) - s**2 / (n + l2), 9)
                    if gain > best[0]:
                        best = (gain, f, b)
        if best[0] <= 0:
            return grow(own, search.DEPTH)
        go = bins[own, best[1]] <= best[2]
        return best[1], best[2], grow(own[go], level + 1), grow(own[~go], level + 1)

    def leaf(node, row):
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        return node

    for _ in range(search.ROUNDS):
        trees.append(grow(np.arange(len(y)), 0))
        rest = rest - np.array([leaf(trees[-1], row) for row in bins])
    return lambda q: np.array([y.mean() + sum(leaf(t, row) for t in trees) for row in value_bins(q)])


def test_models_are_saved_listed_loaded_and_scored(spark, cars, tmp_path):
    root = str(tmp_path)
    assert artifacts.list_models(spark, root).count() == 0
    found = search.grouped_search(cars, encoders.price_stages(["miles"], ["kind"], ["model"]), "price", "vin", ("elastic_net", "random_forest"), most_sets=1)
    for k, family in enumerate(("elastic_net", "random_forest"), 1):
        assert artifacts.save_model(root, "price", found[family].model, {"family": family, "error": found[family].error}) == k
    with pytest.raises(ValueError):
        artifacts.save_model(root, "price", found["elastic_net"].model, {}, version=1)
    with pytest.raises(LookupError):
        artifacts.load_model(spark, root, "other")
    assert sorted((r.name, r.version) for r in artifacts.list_models(spark, root).collect()) == [("price", 1), ("price", 2)]
    asked = cars.where("vin < 150")
    for version, family in ((1, "elastic_net"), (None, "random_forest")):
        model, facts = artifacts.load_model(spark, root, "price", version)
        before, after = (sorted(map(repr, models.predict(x, asked).select("vin", "miles", "prediction").collect())) for x in (found[family].model, model))
        assert before == after and facts["family"] == family
        assert models.feature_weights(model) == models.feature_weights(found[family].model)
        names = {n for n, _, _ in models.feature_weights(model)}
        assert names == {"miles", "kind=a", "kind=b", "model (mean)"} and sum(s for _, _, s in models.feature_weights(model)) == pytest.approx(1)
    scored = models.score_filtered(model, cars, "kind = 'a'", "vin", 20)
    assert scored.count() == 20 and scored.where("kind != 'a' or prediction is null or vin > 40").count() == 0
    whole = models.predict(model, cars.where("price is not null"))
    assert whole.agg(F.corr("prediction", "price")).first()[0] > 0.8


def test_seasonal_autoregression_equals_least_squares(spark):
    r = np.random.default_rng(3)
    series, rows = {}, []
    for k, n in {"long": 60, "mid": 20, "short": 4, "flat": 40}.items():
        y = [50.0 if k == "flat" else float(200 + 10 * math.sin(i / 2) + 3 * i + r.normal() * 5) for i in range(n)]
        series[k] = y
        rows += [(k, month(i), v, i % 7 == 3, 1) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, month_start date, median_price double, interpolated boolean, last_seen int")
    fitted = seasonal.seasonal_ar(df, ["k"])
    got = {(x.k, x.month_start): x for x in fitted.withColumn("next", seasonal.forecast_ar(fitted, 14)).collect()}
    assert len(got) == len(rows)
    for k, y in series.items():
        for i in range(len(y)):
            x, own = got[k, month(i)], np.array(y[: i + 1])
            if i + 1 < 6:
                assert x.reason == "too few months" and x.next is None
                continue
            d = np.diff(own)
            z = d[12:] - d[:-12] if i + 1 >= 36 else d
            lags = [z[11:-1], z[:-12]] if i + 1 >= 36 else [z[:-1]]
            target = z[12:] if i + 1 >= 36 else z[1:]
            if k == "flat":
                assert x.reason == "lags do not vary"
                continue
            w = np.linalg.lstsq(np.column_stack([np.ones(len(target)), *lags]), target, rcond=None)[0]
            assert x.intercept == pytest.approx(w[0], rel=1e-6, abs=1e-6) and x.phi == pytest.approx(w[1], rel=1e-6, abs=1e-7)
            path = list(own)
            for _ in range(14):
                d = np.diff(path)
                if i + 1 >= 36:
                    z = d[12:] - d[:-12]
                    path.append(path[-1] + w[0] + w[1] * z[-1] + w[2] * z[-12] + d[-12])
                else:
                    path.append(path[-1] + w[0] + w[1] * d[-1])
            assert np.allclose(x.next, np.maximum(path[-14:], 0), rtol=1e-5)
    back = forecast.run_families(df, ["k"], ["seasonal_ar", "prophet"], 2)
    rows = back[0].collect()
    assert set(back[1]) == {"prophet"} and {x.k for x in rows} == {"long", "mid"}
    assert all(x.predicted == pytest.approx(got[x.k, x.origin_month].next[1]) and x.actual == series[x.k][(x.forecast_month.year - 2015) * 12 + x.forecast_month.month - 1] for x in rows)


def test_aspects_are_learnt_from_cues_and_scored_by_chunks(spark):
    r = np.random.default_rng(6)
    about = {"reliability_positive": "started every winter morning", "reliability_negative": "towed twice to the garage", "comfort_positive": "seats hug you on trips", "comfort_negative": "every bump hurts my back"}
    cue = {k: sentiment.LEXICON[k.split("_")[0]][k.endswith("negative")].split() for k in about}
    rows = []
    for i in range(480):
        k = list(about)[i % 4]
        filler = " ".join(r.choice(["car", "it", "the", "was", "bought", "mine", "year"], 6))
        rows.append((i, f"{filler} {about[k]} {r.choice(cue[k])}"))
    df = spark.createDataFrame(rows, "id long, text string")
    weak = aspects.weak_labels(df)
    counts = weak.agg(F.sum("reliability_positive"), F.sum("reliability_negative"), F.count_if(F.col("value_positive") == 0)).first()
    assert tuple(counts) == (120, 120, 480)
    which = ("reliability", "comfort", "value")
    model = aspects.fit_aspects(weak, aspects=which)
    assert all(area > 0.95 and n > 60 for name, (n, _, area) in model.held_out.items() if name in about)
    assert model.scorers["value_positive"] == 0.0
    asked = [(1, "my neighbour said it started every winter morning"), (2, "they had it towed twice to the garage."), (3, "seats hug you on trips. " + "filler word here. " * 30 + "towed twice to the garage"), (4, None), (5, ""), (2, "they had it towed twice to the garage.")]
    got = {x.id: x for x in aspects.score_comments(spark.createDataFrame(asked, "id long, text string"), model, "id", aspects=which).collect()}
    assert got[1].reliability_mentioned and got[1].reliability_sentiment > 0.3 and not got[1].comfort_mentioned
    assert got[2].reliability_sentiment < -0.3
    assert got[3].reliability_mentioned and got[3].comfort_mentioned and got[3].reliability_sentiment < 0 < got[3].comfort_sentiment
    assert not got[4].reliability_mentioned and got[4].reliability_sentiment is None and got[5].reliability_confidence == 0 and not got[1].value_mentioned
    cut = spark.createDataFrame(asked, "id long, text string").select("id", F.explode(sentiment.chunks(F.col("text"))).alias("text"))
    scored = aspects.score_chunks(cut, model, which)
    assert scored.columns[:2] == ["id", "text"] and scored.exceptAll(aspects.score_chunks(cut.repartition(2), model, which)).count() == 0


def test_champion_is_trained_and_tested_by_time(spark, monkeypatch):
    """Test rows begin at the cut, training rows lie before it and share no key with them."""
    from ledgerline.plans import learning
    from ledgerline.views import Market

    given = []
    monkeypatch.setattr(learning.models, "train_price_models", lambda df, *a: given.append(df) or (None, None, df.withColumn("prediction", F.lit(0.0))))
    m = Market(spark, "/root/testdata/sf0.01")
    learning.m08(m)
    days = [((r.vin, r.seq, r.price), (r.loaddate - D(1970, 1, 1)).days) for r in m.listings.select("vin", "seq", "price", "loaddate").collect()]
    cut = np.quantile([d for _, d in days], 0.8)
    rows = [(tuple(r)[:3], r.part) for r in given[0].where("part is not null").select("vin", "seq", "price", "part").collect()]
    train, test = (sorted(k for k, part in rows if part == p) for p in ("train", "test"))
    late = {k[0] for k in test}
    assert test == sorted(k for k, d in days if d >= cut)
    assert len(train) >= 100 and train == sorted(k for k, d in days if d < cut and k[0] not in late)


def test_search_leaves_out_folds_without_training_rows(spark):
    rows = spark.range(60).select(F.lit("one").alias("vin"), (F.col("id") % 9).cast("double").alias("x"), (100 + 7 * (F.col("id") % 9)).alias("price"))
    found = search.grouped_search(rows, encoders.price_stages(["x"], [], []), "price", "vin", ("ridge", "gbt"), most_sets=2)
    assert all(math.isinf(e) for f in found.values() for _, e in f.errors)
    assert models.predict(found["gbt"].model, rows).where("abs(prediction - price) > 20").count() == 0


def test_search_writes_only_what_its_stages_read(spark):
    """Columns that no stage reads are not written: here 512 KB of texts that hardly pack."""
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    title = F.concat(*[F.sha2(F.concat_ws("-", F.lit(i), "id"), 256) for i in range(4)])
    rows = spark.range(0, 2_000, 1, 2).select(F.col("id").alias("vin"), (F.col("id") % 9).cast("double").alias("x"), (100 + 7 * (F.col("id") % 9)).alias("price"), title.alias("title"))
    before = size()
    found = search.grouped_search(rows, encoders.price_stages(["x"], [], []), "price", "vin", ("ridge",))
    assert size() - before < 150_000 and found["ridge"].error < 20


def test_champion_reads_joined_rows_once(spark, monkeypatch):
    """Search and errors get a table of the columns that they use, not the joins."""
    from ledgerline.plans import learning
    from ledgerline.views import Market

    given = []
    monkeypatch.setattr(learning.models, "train_price_models", lambda df, *a: given.append(df) or (None, None, df.withColumn("prediction", F.lit(0.0))))
    learning.m08(Market(spark, "/root/testdata/sf0.001"))
    assert "Join" not in given[0]._jdf.queryExecution().optimizedPlan().toString() and "title" not in given[0].columns
