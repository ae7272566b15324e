"""Properties of verbs: shapes, invariances, errors, edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellgrid import registry
from cellgrid.functions import exprs, special
from cellgrid.operators import batch, cluster, discovery, features, metacluster, modeling, neighbors, preprocess, quality, quantiles, reduce, sample, upsample
from cellgrid.sources import bundle, fcs, files
from cellgrid.streaming import flow
from cellgrid.table import CellTable, all_of, any_of, columns, contains, deframe, pull_unless_null, starts_with, with_cell_id


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in ((0, 0, 0), (4, 4, 0), (0, 4, 4))])
    pdf = pd.DataFrame(x, columns=["cd45", "cd19", "cd3"]).assign(cell_id=range(180), label=np.repeat(["a", "b", "c"], 60), patient=np.tile(["p", "q", "r"], 60), stim=np.tile(["u", "s"], 90))
    return spark.createDataFrame(pdf).cache()


MARKERS = ["cd45", "cd19", "cd3"]


def test_selectors(blobs):
    assert columns(blobs, starts_with("cd")) == MARKERS and columns(blobs, contains("LAB")) == ["label"]
    assert columns(blobs, any_of(["cd3", "no"])) == ["cd3"]
    with pytest.raises(ValueError):
        columns(blobs, all_of(["no"]))


def test_preprocess_and_back(blobs):
    there = preprocess.preprocess(blobs, MARKERS)
    back = preprocess.postprocess(there, MARKERS).select(*MARKERS).toPandas()
    assert np.allclose(back, blobs.select(*MARKERS).toPandas())
    with pytest.raises(TypeError):
        preprocess.transform(blobs, MARKERS, None)


def test_downsampling_counts(blobs):
    assert {r[1] for r in sample.downsample(blobs, "label", num_cells=20).groupBy("label").count().collect()} == {20}
    assert sample.downsample(blobs, None, method="prop", prop_cells=0.25).count() == 45
    assert sample.downsample_constant(blobs, "label", 500).count() == 180
    kept = sample.downsample(blobs, None, method="density", density_cols=MARKERS, target_num_cells=60, seed=1).count()
    assert 20 <= kept <= 110
    with pytest.raises(ValueError):
        sample.downsample(blobs, None, method="no")


def test_downsampling_is_random(blobs):
    """Different seeds draw different cells, and over many of them each cell about as often as others."""
    drawn = pd.concat([sample.downsample(blobs, "label", num_cells=20, seed=k).select("cell_id").toPandas() for k in range(12)])["cell_id"].value_counts()
    assert len(drawn) > 170 and drawn.max() <= 11 and drawn.sum() == 720
    one, two = (set(sample.downsample(blobs, None, method="prop", prop_cells=0.25, seed=k).toPandas()["cell_id"]) for k in (1, 2))
    assert len(one) == len(two) == 45 and one != two


def test_weighted_and_repeated_samples(blobs, monkeypatch):
    t = CellTable(blobs.withColumn("w", F.when(F.col("cell_id") % 3 == 0, 9.0).when(F.col("cell_id") % 3 == 1, 1.0)))
    for by in (None, ["label"]):
        got = t.sample(30, by=by, weight_by="w", seed=1).df.toPandas()
        assert len(got) == (90 if by else 30) and got["cell_id"].is_unique and (got["cell_id"] % 3 < 2).all()
        assert (got["cell_id"] % 3 == 0).sum() > 2 * (got["cell_id"] % 3 == 1).sum() or by  # of 20 heavy cells in a group all may be drawn
        for rows in (10**6, 40):
            monkeypatch.setattr(sample, "BUCKET_ROWS", rows)
            got = t.sample(500, by=by, weight_by="w", replace=True, seed=2).df.toPandas()
            counts = got["cell_id"].mod(3).value_counts()
            assert len(got) == (1500 if by else 500) and set(counts.index) == {0, 1} and 6 < counts[0] / counts[1] < 13
    assert len(t.sample(prop=0.5, replace=True).df.toPandas()) == 90 and t.group_by("label").sample(2).df.count() == 6
    assert t.sample(5, weight_by="w").df.limit(0).count() == 0 and CellTable(blobs.limit(0)).sample(5, replace=True).df.count() == 0
    with pytest.raises(ValueError):
        t.sample()


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=5000), rng.integers(0, 5, 3000).astype(float), np.append(np.zeros(4000), rng.normal(size=50)), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
        for share in (0.0, 0.01, 0.5, 0.9, 1.0):
            for most in (100, 10**6):
                assert quantiles.exact_quantile(df, F.col("x"), share, most) == pytest.approx(np.quantile(x, share))
    assert quantiles.exact_quantile(df.limit(0), F.col("x"), 0.5) is None


def test_grouped_table(blobs):
    t = CellTable(blobs).group_by("label")
    assert t.pipe(features.extract_proportion, "stim").df.count() == 3 and t.ungroup().groups == ()
    assert t.group_by("stim", add=True).groups == ("label", "stim") and t.nest().df.count() == 3
    assert t.pipe(sample.downsample_constant, num_cells=4).df.count() == 12
    assert deframe(blobs.select("label", F.lit(1).alias("v")), "label", "v") == {"a": 1, "b": 1, "c": 1} and pull_unless_null(blobs, None) is None


def test_groups_are_searched_in_one_pass(blobs, monkeypatch):
    parts = [neighbors.find_knn(blobs.where(F.col("label") == g), MARKERS, 4).toPandas() for g in "abc"]
    order = lambda d: d.sort_values(["cell_id", "rank"])[["cell_id", "rank", "neighbor_id"]].to_numpy().tolist()
    dense = [neighbors.spade_density(blobs.where(F.col("label") == g), MARKERS, name="d").toPandas() for g in "abc"]
    for numbers in (neighbors.BROADCAST_NUMBERS, 0):
        monkeypatch.setattr(neighbors, "BROADCAST_NUMBERS", numbers)
        monkeypatch.setattr(neighbors, "BLOCK", 25)
        assert order(neighbors.find_knn(blobs, MARKERS, 4, by="label").toPandas()) == order(pd.concat(parts))
        got = neighbors.estimate_density(blobs, MARKERS, "spade", name="d", by="label").toPandas()
        want = pd.concat(dense)
        assert got.sort_values("cell_id")["d"].to_numpy() == pytest.approx(want.sort_values("cell_id")["d"].to_numpy(), nan_ok=True)


def test_counts_within_a_radius(spark, blobs):
    pdf = blobs.select("cell_id", *MARKERS).toPandas().sort_values("cell_id")
    x = pdf[MARKERS].to_numpy()
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    got = neighbors.count_within(blobs, MARKERS, spark.createDataFrame([(0, 0.4)], "g long, radius double")).toPandas().sort_values("cell_id")
    assert got["within"].tolist() == ((far < 0.4).sum(1) - 1).tolist()


@pytest.mark.parametrize("method,options", [("kmeans", {"num_clusters": 3}), ("flowsom", {"xdim": 3, "ydim": 3, "num_metaclusters": 3}), ("phenograph", {"num_neighbors": 10})])
def test_groups_are_clustered_in_one_pass(blobs, method, options):
    out = cluster.cluster(blobs, MARKERS, method, by="stim", seed=1, **options)
    name = f".{'flowsom_meta' if method == 'flowsom' else method + '_'}cluster"
    pairs = out.groupBy("stim", "label", F.col(f"`{name}`").alias("k")).count().toPandas()
    assert out.count() == 180 and pairs.groupby("k")["label"].nunique().max() == 1 and (pairs["k"].str.split("@").str[1] == pairs["stim"]).all()


def test_knn_paths_agree(blobs, monkeypatch):
    one = neighbors.find_knn(blobs, MARKERS, 5).orderBy("cell_id", "rank").toPandas()
    monkeypatch.setattr(neighbors, "BROADCAST_NUMBERS", 0)
    monkeypatch.setattr(neighbors, "BLOCK", 50)
    two = neighbors.find_knn(blobs, MARKERS, 5).orderBy("cell_id", "rank").toPandas()
    assert one["neighbor_id"].tolist() == two["neighbor_id"].tolist() and np.allclose(one["distance"], two["distance"])
    near = neighbors.find_knn(blobs, MARKERS, 5, approximate=True).toPandas()
    recall = len(set(zip(one["cell_id"], one["neighbor_id"])) & set(zip(near["cell_id"], near["neighbor_id"]))) / len(one)
    assert recall > 0.9


@pytest.mark.parametrize("metric", neighbors.METRICS)
def test_knn_is_brute_force(blobs, metric):
    pdf = blobs.select("cell_id", *MARKERS).toPandas().sort_values("cell_id")
    x = pdf[MARKERS].to_numpy() + 1
    got = neighbors.find_knn(blobs.withColumns({c: F.col(c) + 1 for c in MARKERS}), MARKERS, 3, metric).orderBy("cell_id", "rank").toPandas()
    for i in (0, 77, 179):
        d = neighbors.exact_distance(np.broadcast_to(x[i], x.shape), x, metric)
        d[i] = np.inf
        assert got[got["cell_id"] == i]["distance"].to_numpy() == pytest.approx(np.sort(d)[:3])


@pytest.mark.parametrize("method,options", [("kmeans", {"num_clusters": 3}), ("flowsom", {"xdim": 4, "ydim": 4, "num_metaclusters": 3}), ("phenograph", {"num_neighbors": 15})])
def test_clusters_follow_blobs(blobs, method, options):
    out = cluster.cluster(blobs, MARKERS, method, seed=1, **options)
    name = [c for c in out.columns if c not in blobs.columns][0]
    pairs = out.groupBy("label", F.col(f"`{name}`").alias("k")).count().toPandas()
    assert pairs.groupby("k")["label"].nunique().max() == 1 and out.count() == 180


def test_classification_and_upsampling(blobs):
    for distance in ("mahalanobis", "cosine", "pearson"):
        out = upsample.upsample(blobs, blobs, "label", MARKERS, distance=distance)
        assert out.count() == 180
    out = upsample.upsample(blobs, blobs, "label", MARKERS)
    assert out.where(F.col("`.upsample_cluster`") == F.col("label")).count() == 180
    out = upsample.upsample(blobs, blobs.where("cell_id % 2 = 0"), "label", MARKERS, method="neighbor", num_neighbors=3)
    assert out.where(F.col("`.upsample_cluster`") == F.col("label")).count() == 180
    with pytest.raises(ValueError):
        cluster.cluster_ddpr(blobs.withColumn("z", F.lit(1.0)), blobs.withColumn("z", F.lit(1.0)), "label", ["cd3", "z"])


@pytest.mark.parametrize("method", ["hierarchical", "kmeans", "phenograph", "consensus", "flowsom"])
def test_metaclusters_keep_rows(blobs, method):
    c = blobs.withColumn("k", F.concat("label", F.lit("_"), (F.col("cell_id") % 3).cast("string")))
    out = metacluster.metacluster(c, "k", MARKERS, method)
    assert out.count() == 180 and out.groupBy("k").agg(F.count_distinct(f"`.{method}_metacluster`").alias("n")).where("n <> 1").isEmpty()


def test_proportions_are_filled_and_add_up(blobs):
    some = blobs.where("NOT (label = 'a' AND patient = 'p')")
    long = features.extract_proportion(some, "label", "patient", "long").toPandas()
    assert len(long) == 9 and np.allclose(long.groupby("patient")["prop"].sum(), 1) and (long["prop"] == 0).sum() == 1


def test_distribution_distances_are_symmetric(blobs):
    for verb, name in ((features.extract_emd, "emd"), (features.extract_jsd, "jsd")):
        arg = {f"{name}_col": "stim"}
        a = verb(blobs, "label", MARKERS, None, reference_level="u", format="long", **arg).orderBy("label", "channel").toPandas()
        b = verb(blobs, "label", MARKERS, None, reference_level="s", format="long", **arg).orderBy("label", "channel").toPandas()
        assert np.allclose(a[name], b[name]) and (a[name] >= 0).all()


def test_features_side_by_side(blobs):
    for method in ("threshold", "emd", "jsd", "central tendency"):
        out = features.extract_features(blobs, "label", "patient", ["cd45"], ["cd3"], "stim", "u", method)
        assert out.count() == 3 and "prop@a" in out.columns


def test_quality_flags(blobs):
    out = quality.assess_channels(blobs, MARKERS, negative_threshold=1e9)
    assert out.where("flagged_channel").count() == 3
    timed = blobs.withColumn("time", F.col("cell_id").cast("double"))
    assert quality.flow_rate(timed, "time", 180).where("num_cells <> 1").isEmpty()
    with pytest.raises(ValueError):
        quality.flow_rate(timed, "time", 500, by="label")
    flagged = quality.assess_clusters_knn(blobs.withColumn("label", F.when(F.col("cell_id") == 3, "b").otherwise(F.col("label"))), "label", MARKERS, 10)
    assert [r.cell_id for r in flagged.where("flagged_cell").collect()] == [3]


def test_batch_correction_ranges(blobs):
    out = batch.batch_correct(blobs, MARKERS, "label").agg(F.min("cd45"), F.max("cd45")).first()
    assert tuple(out) == (0.0, 1.0)
    row = batch.batch_correct(blobs.select(*MARKERS), MARKERS, None, method="quantile").toPandas()
    assert np.allclose(np.sort(row.to_numpy(), axis=1), np.sort(row.to_numpy(), axis=1)[0])


def test_paired_t_test_by_hand(spark):
    pdf = pd.DataFrame([(p, s, c) for p in range(8) for s in ("u", "s") for c in ["a"] * (5 + p + 2 * (s == "u")) + ["b"] * 20], columns=["patient", "stim", "label"])
    got = discovery.analyze_abundance(spark.createDataFrame(pdf), "label", effect_col="stim", group_cols="patient", test_type="paired", effect_levels=["u", "s"]).toPandas().set_index("label")
    share = pdf.groupby(["patient", "stim"])["label"].value_counts(normalize=True).unstack()["a"].unstack()
    d = share["u"] - share["s"]
    assert got.loc["a", "t"] == pytest.approx(d.mean() / (d.std() / np.sqrt(8))) and got.loc["a", "df"] == 7
    assert got["p_val"].between(0, 1).all() and (got["p_adj"] >= got["p_val"] - 1e-12).all()
    with pytest.raises(ValueError):
        discovery.analyze_abundance(spark.createDataFrame(pdf), "label", effect_col="patient", group_cols="stim")


def test_discovery_models_run(blobs):
    c = blobs.withColumn("sample", (F.col("cell_id") % 9).cast("string")).withColumn("arm", F.when(F.col("cell_id") % 9 < 5, "x").otherwise("y"))
    for method in ("glmm", "edgeR", "voom"):
        assert discovery.analyze_abundance_diffcyt(c, "label", "sample", "arm", method=method).count() == 3
    for method in ("lmm", "limma"):
        assert discovery.analyze_expression_diffcyt(c, "label", "sample", "arm", marker_cols=MARKERS, method=method).count() == 9
    with pytest.raises(ValueError):
        discovery.analyze_abundance_diffcyt(c, "label", "sample", "arm", "sample", method="edgeR")


def test_p_values_that_waver_are_adjusted(spark):
    """As those of tests over many cells do when they are worked out twice, with sums in another order."""
    wavering = F.udf(lambda i: (i + 1) / 50 + 1e-12 * np.random.default_rng().random(), "double").asNondeterministic()
    given = spark.range(40).withColumn("p_val", F.when(F.col("id") < 38, wavering("id")))
    got = discovery.bh_adjust(given).toPandas().sort_values("id")
    assert got["p_adj"].to_numpy() == pytest.approx(special.benjamini_hochberg(got["p_val"].to_numpy(float)), nan_ok=True)
    assert got["p_adj"].notna().sum() == 38


def test_pca_is_eigen(blobs):
    fit = reduce.fit_pca(blobs, MARKERS, 3)
    x = blobs.select(*MARKERS).toPandas().to_numpy()
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    assert np.sort(fit.variances) == pytest.approx(np.sort(np.linalg.eigvalsh(np.cov(z.T))))
    assert [c for c in reduce.reduce_dimensions(blobs, MARKERS).columns if c.startswith(".pc")] == [".pc1", ".pc2", ".pc3"]


def test_embeddings_have_shape(blobs):
    for method, options in (("tsne", {"max_iterations": 50}), ("umap", {"epochs": 20})):
        out = reduce.reduce_dimensions(blobs, MARKERS, method, augment=False, **options)
        assert out.count() == 180 and len(out.columns) == 2


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(100, 3))
    y = 2 * x[:, 0] + rng.normal(0, 0.1, 100)
    pdf = pd.DataFrame(x, columns=["f1", "f2", "f3"]).assign(id=range(100), outcome=y, cls=np.where(y > 0, "pos", "neg"), multi=np.select([y < -1, y > 1], ["l", "h"], "m"), time=rng.exponential(np.exp(-y)), event=1.0)
    return spark.createDataFrame(pdf)


def test_splits(samples):
    k = modeling.split_data(samples, "k-fold", 5)
    assert k.groupBy("id").agg(F.sum((F.col("role") == "assessment").cast("int")).alias("n")).where("n <> 1").isEmpty()
    b = modeling.split_data(samples, "bootstrap", num_bootstraps=3).groupBy("split_id", "role").count().toPandas()
    assert (b[b["role"] == "analysis"]["count"] == 100).all()
    assert modeling.split_data(samples, "simple").where("role = 'analysis'").count() == 75


@pytest.mark.parametrize("kind,outcome", [("linear", "outcome"), ("two-class", "cls"), ("multiclass", "multi"), ("survival", ["time", "event"])])
def test_models_learn(spark, samples, kind, outcome):
    splits = modeling.split_data(samples, "k-fold", 3)
    model = modeling.train_model(splits, ["f1", "f2", "f3"], kind, outcome, modeling.create_grid(spark, [1e-3, 1e-1], [1.0]))
    found = modeling.assess_model(model)
    row = found["model_metrics"].first().asDict()
    assert {"linear": lambda: row["mse"] < 0.1, "two-class": lambda: row["roc_auc"] > 0.95, "multiclass": lambda: row["accuracy"] > 0.8, "survival": lambda: row["concordance_index"] > 0.7}[kind]()
    assert modeling.predict(model).count() == 100 and "f1" in repr(model) and modeling.assess_model(model, samples)["model_metrics"].count() == 1


def test_equal_samples_stay_apart(spark, samples):
    twice = samples.union(samples.where("id < 10"))
    assert modeling.all_rows(modeling.split_data(twice, "k-fold", 4)).count() == 110
    assert modeling.all_rows(modeling.split_data(twice, "simple")).count() == 110
    assert modeling.all_rows(modeling.split_data(samples, "bootstrap", num_bootstraps=3)).count() == 100


def test_split_by_a_list(samples):
    got = modeling.split_data(samples, split=[k % 4 > 0 for k in range(100)], order_by="id").toPandas()
    assert set(got.loc[got["role"] == "assessment", "id"]) == set(range(0, 100, 4)) and got.columns.tolist() == [*samples.columns, "split_id", "role"]
    for bad in ({"split": [True]}, {"split": [True] * 100, "order_by": "event"}):
        with pytest.raises(ValueError):
            modeling.split_data(samples, **({"order_by": "id"} | bad))


def test_thresholds_by_hand():
    rng = np.random.default_rng(2)
    risk, time, event = rng.integers(0, 8, 40).astype(float), rng.integers(1, 12, 40).astype(float), rng.integers(0, 2, 40).astype(float)
    risk[3] = np.inf
    got = modeling.log_rank_thresholds(risk, time, event)
    good = np.isfinite(risk)
    assert got["threshold"].tolist() == sorted(set(risk[good]))
    for cut, p in got.itertuples(index=False):
        o = v = 0.0
        for t in sorted(set(time[good & (event > 0)])):
            at, high = good & (time >= t), good & (time >= t) & (risk > cut)
            n, n1, d, d1 = at.sum(), high.sum(), (at & (time == t) & (event > 0)).sum(), (high & (time == t) & (event > 0)).sum()
            o, v = o + d1 - d * n1 / n, v + (d * n1 / n * (1 - n1 / n) * (n - d) / (n - 1) if n > 1 else 0)
        assert p == pytest.approx(float(special.chi2_tail(o * o / v, 1)) if v > 1e-12 else 1.0)


def test_tail_of_chi_squared_as_an_expression(spark):
    x = [0.0, 1e-9, 0.01, 0.5, 1.0, 3.84, 10.0, 50.0, 300.0]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", exprs.erfc(F.sqrt(F.col("x") / 2)).alias("p")).collect()
    assert [r.p for r in got] == pytest.approx([float(special.chi2_tail(r.x, 1)) for r in got], rel=3e-7)


def test_survival_of_too_many_samples_is_refused(spark, samples, monkeypatch):
    model = modeling.train_model(modeling.split_data(samples, "k-fold", 2), ["f1"], "survival", ["time", "event"], modeling.create_grid(spark, [1e-3], [1.0]))
    monkeypatch.setattr(modeling, "MAX_SAMPLES", 50)
    with pytest.raises(ValueError):
        modeling.assess_model(model, samples)


@pytest.mark.parametrize("kind, outcome", [("linear", "y"), ("two-class", "c"), ("multiclass", "c"), ("survival", ["time", "event"])])
def test_models_of_many_samples(spark, kind, outcome):
    many = spark.range(200_100).select(
        (F.col("id") % 997 / 997).alias("f"), (F.col("id") % 997 / 997 + F.rand(1)).alias("y"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("c"),
        (1 + F.col("id") % 401).cast("double").alias("time"), (F.col("id") % 2).cast("double").alias("event"), (F.col("id") % 5 > 0).alias("used"), F.lit("unused").alias("more"),
    )
    model = modeling.train_model(modeling.split_data(many, split="used"), ["f"], kind, outcome, modeling.create_grid(spark, [1e-6], [0.5]))
    assert model.cv_predictions.count() == 40_020 and np.isfinite(model.coefficients).all()
    for table in modeling.assess_model(model, many).values():
        assert not table.isEmpty()


def test_log_rank_of_one_stratum(samples):
    assert modeling.log_rank_test(samples, "time", "event", F.lit(True)).first().p_val == 1.0


def test_files_round_trip(spark, blobs, tmp_path):
    files.write_data(blobs.select("label", *MARKERS), str(tmp_path / "fcs"), "label", "fcs")
    read = files.read_data(spark, str(tmp_path / "fcs"))["1"]
    assert read.df.count() == 180 and set(r[0] for r in read.df.select("file_name").distinct().collect()) == {"a.fcs", "b.fcs", "c.fcs"}
    files.write_csv(blobs.select("label", *MARKERS), str(tmp_path / "csv"), "label", single_files=True)
    assert files.read_data(spark, str(tmp_path / "csv"))["1"].df.count() == 180
    with pytest.raises(ValueError):
        files.write_csv(blobs, str(tmp_path / "x"))


def test_fcs_files_of_many_pieces(spark, tmp_path, monkeypatch):
    """No piece that is written or read, by the driver or a task, is a whole file."""
    monkeypatch.setattr(fcs, "PIECE", 4_000)
    cells = spark.range(0, 20_000, 1, 12).select((F.col("id") % 2).cast("string").alias("g"), F.col("id").cast("double").alias("a"), (F.col("id") / 7).alias("b"))
    pieces = fcs.fcs_pieces(cells, "g")[0]
    assert pieces.count() > 10
    files.write_data(cells, str(tmp_path / "fcs"), "g", "fcs")
    read = files.read_data(spark, str(tmp_path / "fcs"))["1"].df
    got = read.groupBy("file_name").agg(F.count("*").alias("n"), F.sum("a").alias("a"), F.max(F.abs(F.col("b") - F.col("a") / 7)).alias("off")).orderBy("file_name").collect()
    assert [tuple(r)[:3] for r in got] == [("0.fcs", 10_000, 99_990_000.0), ("1.fcs", 10_000, 100_000_000.0)] and max(r.off for r in got) < 1e-3


def test_layouts_of_many_cells(spark, monkeypatch):
    """Beyond the dense matrices, and beyond what used to be refused; clusters stay apart."""
    from cellgrid.plans import plotdata

    monkeypatch.setattr(reduce, "MAX_DENSE", 1 << 20)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4)) + np.arange(600)[:, None] % 3 * 30
    cells = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "cell_id long, a double, b double, c double, d double")
    for method, options in (("tsne", {"max_iterations": 300, "perplexity": 15.0}), ("umap", {"epochs": 60})):
        y = reduce.reduce_dimensions(cells, ["a", "b", "c", "d"], method, **options).orderBy("cell_id").select(f"`.{method}1`", f"`.{method}2`").toPandas().to_numpy()
        d = ((y[:, None] - y[None]) ** 2).sum(2) + np.diag(np.full(600, np.inf))
        assert np.isfinite(y).all() and ((np.argsort(d, 1)[:, :5] - np.arange(600)[:, None]) % 3 == 0).mean() > (0.97 if method == "tsne" else 0.6)
    with pytest.raises(ValueError):
        reduce.reduce_umap(cells, ["a", "b"], max_cells=100)
    many = spark.range(20_100).select(F.col("id").alias("cell_id"), F.rand(1).alias("a"))
    nodes, edges = plotdata.cells_layout(many, ["a"], 2, rounds=1)
    assert nodes.count() == 20_100 and edges.count() == 40_200


@pytest.mark.parametrize("dims", [1, 2])
def test_repulsion_through_a_grid(dims):
    y = np.random.default_rng(0).normal(size=(400, dims)) * 6
    gap = y[:, None] - y[None]
    k = 1 / (1 + (gap * gap).sum(2)) - np.eye(400)
    push, total = reduce._repulsion(y)
    want = ((k**2)[..., None] * gap).sum(1)
    assert total == pytest.approx(k.sum(), rel=0.02) and np.abs(push - want).max() < 0.1 * np.abs(want).max()


def test_heatmap_of_many_rows(spark):
    many = spark.range(6_000).select("id", (F.col("id") % 3 * 100 + F.col("id") / 6_000).alias("a"), (F.col("id") % 3 * 50).cast("double").alias("b"), F.lit(1.0).alias("c"))
    from cellgrid.plans import plotdata

    got = plotdata.sample_features(many, "id").toPandas()
    a = got[got["channel"] == "a"].assign(id=lambda t: t["row"].astype(int)).sort_values("id")
    assert len(got) == 18_000 and a["value"].to_numpy() == pytest.approx((a["id"] % 3 * 100 + a["id"] / 6_000).to_numpy())
    assert sorted(a["row_order"]) == list(range(6_000)) and got.groupby("channel")["channel_order"].nunique().max() == 1
    near = np.abs(np.diff(a.sort_values("row_order")["value"]))
    assert (near > 10).sum() < 200  # of 4,000 in the given order


def test_bundle_round_trip(blobs):
    back = bundle.from_bundle(bundle.to_bundle(CellTable(blobs), MARKERS)).df
    assert np.allclose(back.orderBy("cell_id").select(*MARKERS).toPandas(), blobs.orderBy("cell_id").select(*MARKERS).toPandas())


def test_frames(spark, blobs):
    one = bundle.as_frame(blobs.select("cd45", F.col("cd19").alias("cd19|Nd142"), "label"))
    assert one.exprs.columns == ["cd45", "cd19_Nd142"] and one.parameters.count() == 2
    back = bundle.from_frame(one)
    assert back.df.columns == ["cd45", "cd19|Nd142"] and {tuple(r) for r in back.panel.collect()} == {("cd45", "cd45"), ("Nd142", "cd19")}
    many = bundle.as_frame_set(blobs.select("label", *MARKERS), "label")
    assert {tuple(r) for r in many.metadata.collect()} == {("Sample_1", "a"), ("Sample_2", "b"), ("Sample_3", "c")}
    assert {tuple(r) for r in many.exprs.groupBy("sample").count().collect()} == {(f"Sample_{k}", 60) for k in (1, 2, 3)} and many.parameters.count() == 3


def test_flow_rate_of_a_stream(spark, tmp_path):
    """The same counts from a stream in several batches as from the table, once the watermark has passed."""
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", "ab"[m % 2]) for h in range(12) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "at string, kind string").select(F.col("at").cast("timestamp").alias("ts"), "kind")
    for k in range(3):
        df.where(F.hour("ts").between(4 * k, 4 * k + 3)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    running = flow.stream_flow_rate(stream, "ts", "2 hours", "1 hour", by="kind")
    running.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("kind", "start", "num_cells").collect()}
    whole = {tuple(r) for r in flow.stream_flow_rate(df, "ts", "2 hours", by="kind").select("kind", "start", "num_cells").collect()}
    assert got <= whole and len(got) >= 6


def test_scratch_is_dropped(spark, blobs):
    from cellgrid import storage

    storage.materialize(blobs)
    assert storage.drop_scratch(spark) > 0 and storage.drop_scratch(spark) == 0


def test_table_keeps_panel(spark, blobs):
    panel = spark.createDataFrame([("Nd142", "cd19")], "metals string, antigens string")
    t = CellTable(blobs, panel).mutate(x=F.lit(1)).filter("cell_id < 10").nest(["label"]).unnest()
    assert t.panel is panel and t.df.count() == 10
    assert t.pivot_longer(MARKERS).df.count() == 30


def test_cell_ids_are_consecutive(blobs):
    got = with_cell_id(blobs.drop("cell_id"), ["cd45", "cd19", "cd3"]).select("cell_id").toPandas()["cell_id"]
    assert sorted(got) == list(range(1, 181))


def test_registered_method(blobs):
    registry.register("cluster", "mine")(lambda df, cols=None: df.withColumn(".mine_cluster", F.lit("1")))
    assert registry.call("cluster", blobs, MARKERS, method="mine").where("`.mine_cluster` = '1'").count() == 180
    assert registry.call("downsample", blobs, None, method="constant", num_cells=5).count() == 5


def test_empty_tables(blobs):
    none = blobs.limit(0)
    assert features.extract_proportion(none, "label", "patient").count() == 0
    assert sample.downsample_constant(none, "label", 5).count() == 0
    assert batch.batch_correct(none, MARKERS, "label").count() == 0
    assert neighbors.find_knn(none, MARKERS, 3).count() == 0
