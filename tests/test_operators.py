"""Filters, splits, scores, neighbours and experiments on small tables."""

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from neumatic.operators import analysis, embed, filters, knn, metrics, models, split, tfidf
from neumatic.plans import catalogue, experiment
from neumatic.sources import tables, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def chants(spark):
    return views.melodies(spark, SF).cache()


def test_exact_sample(spark):
    for n in (0, 1, 10, 4095):
        df = split.exact_sample(spark.range(n), 0.7)
        assert df.where("is_train").count() == round(0.7 * n)
        assert df.count() == n


def test_stratified_folds(spark):
    rows = spark.range(103).withColumn("label", F.when(F.col("id") < 80, 0).otherwise(1))
    counts = split.stratified_folds(rows, "label", 5).groupBy("label", "fold").count().collect()
    for label in (0, 1):
        n = [r["count"] for r in counts if r.label == label]
        assert len(n) == 5 and max(n) - min(n) <= 1


def test_unique_notes_keeps_first(spark):
    df = spark.createDataFrame([(2, "1---fg"), (1, "1---f-g"), (3, "1---gf")], "id long, volpiano string")
    assert sorted(r.id for r in filters.unique_notes(df).collect()) == [1, 3]


def test_funnel_agrees_with_filters(chants):
    rows = filters.funnel(chants, filters.pipeline("en")).orderBy("step_no").collect()
    kept = chants
    for row, (name, keep) in zip(rows, filters.pipeline("en")):
        kept = kept.where(keep)
        assert (row.step, row.after) == (name, kept.count())


def test_tfidf_unit_norm(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "id long, units array<string>")
    norms = tfidf.tfidf(df).groupBy("id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert len(norms) == 2 and all(abs(r.n - 1) < 1e-9 for r in norms)


def test_nearest_equals_all_differences():
    own = np.random.default_rng(3)
    for v, q, k in ((own.normal(size=(300, 16)), own.normal(size=(40, 16)), 5), (own.integers(0, 2, (400, 5)) * 1e5, own.integers(0, 2, (30, 5)) * 1e5, 7), (np.ones((knn.CANDIDATES + 9, 2)), np.ones((3, 2)), 4), (own.normal(size=(3, 2)), own.normal(size=(4, 2)), 9)):
        d = np.sqrt(((q[:, None, :] - v[None]) ** 2).sum(-1))
        best = np.argsort(d, axis=1, kind="stable")[:, :k]
        expected = [(i, j, d[i, j]) for i in range(len(q)) for j in best[i]]
        assert sorted(zip(*knn.nearest(v, q, k)), key=lambda r: r[0]) == expected


def test_scores_read_predictions_once(spark):
    pairs = spark.range(40).selectExpr("id % 3 as y", "id % 4 as p").mapInPandas(lambda frames: frames, "y long, p long")
    rows = metrics.by_class(pairs)
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    none = spark.createDataFrame([(None, 1), (1, None), (1, 1)], "y int, p int")
    assert sorted(map(str, metrics.by_class(none).collect())) == sorted(["Row(label=None, precision=0.0, recall=0.0, f1=0.0, support=0)", "Row(label=None, precision=0.0, recall=0.0, f1=0.0, support=1)", "Row(label=1, precision=0.5, recall=0.5, f1=0.5, support=2)"])


def test_knn_blocks_agree(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist(), i % 3) for i in range(60)], "vec_id long, embedding array<double>, label int")
    train, rest = df.where("vec_id < 40"), df.where("vec_id >= 40")
    whole = sorted(map(tuple, knn.neighbours(train, rest, 4).collect()))
    assert whole == sorted(map(tuple, knn.neighbours(train, rest, 4, block_rows=7).collect()))
    same = knn.vote(knn.neighbours(train, train, 4), "distance").join(train, F.col("query") == F.col("vec_id"))
    assert same.where("prediction <> label").count() == 0  # at distance 0 only the row itself votes


def test_scores(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    row = metrics.scores(pairs).first()
    assert row.accuracy == 0.5 and abs(row.weighted_precision - (2 * 1 + 1 / 3) / 4) < 1e-9
    assert analysis.majority(pairs.withColumn("g", F.lit(1)), ["g"], "y").first().majority == 0


def test_percent_cell_rounds_as_printf(spark):
    counts = [(n, total) for total in (1, 3, 7, 32, 64, 200, 800, 1600, 2000, 4000, 32000) for n in range(0, total + 1, max(1, total // 500))]
    got = spark.createDataFrame(counts, "n long, total long").select("n", "total", analysis.percent_cell("n", "total").alias("cell")).collect()
    assert [(r.n, r.total, r.cell) for r in got] == [(n, total, f"{100 * n / total:.2f}%") for n, total in counts]


def test_majority_percent_equals_sql(spark):
    sf_dir = SF.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{sf_dir}/customer.parquet'")
    got = [tuple(r) for r in catalogue.queries()["majority_percent"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(con.execute(catalogue.oracle_sql()["majority_percent"]).fetchall())


def test_embeddings_and_models(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (30, 4)), rng.normal(5, 1, (30, 4))])
    df = spark.createDataFrame([(i, float(i >= 30), v.tolist()) for i, v in enumerate(x)], "id long, label double, v array<double>")
    df = df.select("id", "label", array_to_vector("v").alias("features"))
    xs = np.array([[r.x, r.y] for r in embed.pca(df).orderBy("id").collect()])
    assert abs(xs.mean(0)).max() < 1e-6 and (xs[:30, 0].mean() > 0) != (xs[30:, 0].mean() > 0)
    assert embed.svd(df).count() == 60
    y = np.array([[r.x, r.y] for r in embed.tsne(df, steps=100).orderBy("id").collect()])
    assert np.isfinite(y).all()
    for make in (models.Forest(n_estimators=5), models.SquaredMargin(C=0.1, steps=20), models.Nearest(3)):
        assert metrics.accuracy(make.fit(df).predict(df)).first()[0] > 0.95


def test_conditions():
    assert len(experiment.conditions("tfidf")) == 440
    assert len(experiment.conditions("traditional")) == 28
    assert len(experiment.conditions("profile", genres=["antiphon"], profiles="all")) == 6


def test_dataset_and_experiment(spark, chants, tmp_path):
    kept = chants.where("volpiano is not null and mode is not null")
    kept = kept.where(F.length("volpiano") < 1500).withColumn("volpiano", F.concat(F.lit("1---"), F.regexp_replace("volpiano", r"[^a-k-]", ""))).withColumn("mode", F.substring("mode", 1, 1)).withColumn("full_text", F.lit("x"))
    experiment.generate_datasets(kept, str(tmp_path / "data"), genre_ids={"responsory": "en", "antiphon": "fr"})
    condition = {"profile": "pitch", "genre": "responsory", "subset": "full"}
    train = experiment.load(spark, str(tmp_path / "data"), "profile", condition, "train")
    test = experiment.load(spark, str(tmp_path / "data"), "profile", condition, "test")
    assert train.join(test, "id").count() == 0 and train.count() > test.count() > 0
    tuned = experiment.run_condition(spark, str(tmp_path / "data"), str(tmp_path / "results"), "profile", condition, n_iter=1, n_splits=2)
    assert len(tuned) == 1 and "std_train_weighted_f1" in tuned[0]
    scores = experiment.evaluate_condition(spark, str(tmp_path / "data"), str(tmp_path / "results"), "profile", condition)
    assert 0 <= scores["test_accuracy"] <= 1
    lines = tables.read_predictions(spark, str(tmp_path / "results" / "pitch-responsory-full-test-pred.txt"))
    assert lines.count() == test.count()


def test_embedding_grid(spark, chants, tmp_path):
    rows = chants.where("volpiano is not null").select("id", (F.col("id") % 8).cast("string").alias("mode"), F.split(F.regexp_replace(F.substring("volpiano", 1, 300), "-+", " "), " ").alias("units"))
    base, own = str(tmp_path), "genre=responsory/subset=full"
    rows.select(F.concat(F.lit("chant_"), "id").alias("id"), (F.col("mode") + 1).cast("int").cast("string").alias("mode"), F.lit("test").alias("split")).write.partitionBy("split").parquet(f"{base}/chants/{own}")
    rows.select(F.concat(F.lit("chant_"), "id").alias("id"), "units", F.lit("test").alias("split"), F.lit("pitch").alias("representation"), F.lit("words").alias("segmentation")).write.partitionBy("split", "representation", "segmentation").parquet(f"{base}/representations/{own}")
    chosen = {"genres": ["responsory"], "subsets": ["full"], "representations": ["pitch"], "segmentations": ["words"], "splits": ["test"]}
    paths = experiment.run_embeddings(spark, base, f"{base}/results", embedders=["svd"], rows=40, **chosen)
    found = spark.read.option("header", True).csv(paths[0])
    assert set(found.columns) == {"id", "x", "y", "mode"} and found.count() == 40
    experiment.run_embeddings(spark, base, f"{base}/results", embedders=["svd"], rows=7, **chosen)
    assert spark.read.option("header", True).csv(paths[0]).count() == 40  # it stays
    experiment.run_embeddings(spark, base, f"{base}/results", embedders=["svd"], rows=7, refresh=True, **chosen)
    assert spark.read.option("header", True).csv(paths[0]).count() == 7


def labelled(spark, n=80, width=5):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, n)
    x = rng.normal(0, 1, (n, width)) + 1.2 * np.eye(width)[y]
    df = spark.createDataFrame([(i, float(c), v.tolist()) for i, (c, v) in enumerate(zip(y, x))], "id long, label double, v array<double>")
    return x, y, df.select("id", "label", array_to_vector("v").alias("features"))


def test_projections_equal_numpy(spark):
    x, _, df = labelled(spark)
    for found, matrix, z in ((embed.pca(df), x - x.mean(0), ("x", "y")), (embed.svd(df).select("id", F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y")), x, ("x", "y"))):
        got = np.array([[r[c] for c in z] for r in found.orderBy("id").collect()])
        expected = matrix @ np.linalg.svd(matrix, full_matrices=False)[2][:2].T
        assert np.allclose(np.abs(got), np.abs(expected), atol=1e-6)


def test_squared_margin_finds_the_minimum(spark):
    x, y, df = labelled(spark)
    model = models.SquaredMargin(C=0.1, steps=150).fit(df)
    ones, signs = np.column_stack([x, np.ones(len(x))]), np.where(np.arange(3)[:, None] == y[None], 1.0, -1.0)

    def risk(w):
        return 0.5 * (w * w).sum() + 0.1 * (np.maximum(0, 1 - signs * (w @ ones.T)) ** 2).sum()

    w = np.zeros_like(model.w)
    for _ in range(20_000):
        w -= 0.01 * (w - 0.2 * (signs * np.maximum(0, 1 - signs * (w @ ones.T))) @ ones)
    assert risk(model.w) < 1.001 * risk(w)


def test_models_come_back(spark, tmp_path):
    _, _, df = labelled(spark)
    for kind, (make, _) in models.CLASSIFIERS.items():
        model = {"random_forest": lambda: make(n_estimators=4, max_depth=3), "knn": lambda: make(4, "distance"), "linear_svc": lambda: make(steps=5), "hinge_svc": lambda: make(iterations=3)}[kind]().fit(df)
        models.save(model, str(tmp_path / kind), spark)
        again = models.load(str(tmp_path / kind), spark)
        assert type(again) is make and sorted(map(tuple, again.predict(df).collect())) == sorted(map(tuple, model.predict(df).collect()))


def test_tuning_scores_equal_brute_force(spark):
    x, y, df = labelled(spark, 40)
    folded = split.stratified_folds(df, "label", 2).cache()
    fold = {r.id: r.fold for r in folded.collect()}
    for row in models.tune(folded, "knn", 2, space={"n_neighbors": [3, 5], "weights": ["uniform"]}):
        k, scores = row["params"]["n_neighbors"], []
        for f in (0, 1):
            known = [i for i in range(40) if fold[i] != f]
            right = 0
            for i in (i for i in range(40) if fold[i] == f):
                near = sorted(known, key=lambda j: (((x[i] - x[j]) ** 2).sum(), j))[:k]
                votes = [y[j] for j in near]
                right += min(set(votes), key=lambda c: (-votes.count(c), c)) == y[i]
            scores.append(right / (40 - len(known)))
        assert abs(row["mean_test_accuracy"] - np.mean(scores)) < 1e-9


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", 'say "x",\nthen'), ("a", None)], "id string, volpiano string")
    tables.write_csv(df, str(tmp_path / "c.csv"))
    back = tables.read_chants(spark, str(tmp_path / "c.csv"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_csv_is_written_by_more_than_one_task(spark, tmp_path):
    """In order of its key, file by file."""
    df = spark.range(4000).selectExpr("lpad(cast(id * 7919 % 4000 as string), 5, '0') as id", "repeat('a-b', 90) as volpiano").repartition(6)
    tables.write_csv(df, str(tmp_path / "c.csv"))
    files = sorted(tmp_path.joinpath("c.csv").glob("part-*"))
    assert len(files) > 1
    keys = [line.split(",")[0] for f in files for line in f.read_text().splitlines()[1:]]
    assert keys == sorted(keys) and len(keys) == 4000
    assert tables.checksum(tables.read_chants(spark, str(tmp_path / "c.csv"), df.schema)) == tables.checksum(df)


def test_predictions_of_many_files_keep_their_order(spark, tmp_path):
    df = spark.range(5000).selectExpr("id * 31 % 5000 as id").selectExpr("id", "int(id % 7) as p").repartition(5)
    tables.write_predictions(df, str(tmp_path / "p"))
    assert sorted(map(tuple, tables.read_predictions(spark, str(tmp_path / "p")).collect())) == [(i, i % 7) for i in range(5000)]


def test_singular_vectors_without_the_rows(spark):
    x = np.random.default_rng(4).normal(size=(90, 5)) * [9, 4, 3, 2, 1]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>").select("id", array_to_vector("v").alias("features")).repartition(3)
    found, expected = embed.right_vectors(df, 2), np.linalg.svd(x, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs((found * expected).sum(0)), 1)
    flat = df.select("id", array_to_vector(F.array(F.col("id").cast("double") + 1, F.lit(0.0))).alias("features"))
    assert embed.right_vectors(flat, 2).shape == (2, 1)


ORACLES = ["process_volpiano", "contour_dependent", "repetition_profile", "filter_funnel", "train_test_split", "stratified_folds", "tfidf_vocab_topk", "classification_report", "dataset_statistics"]


@pytest.mark.parametrize("name", ORACLES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    expected = con.execute(catalogue.oracle_sql()[name]).df()
    found = catalogue.queries()[name](spark, SF).toPandas()
    columns = sorted(found.columns)
    assert columns == sorted(expected.columns)
    text = lambda df: sorted(map(tuple, df[columns].astype(object).where(df[columns].notna(), "null").map(lambda v: f"{float(v):.6f}" if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)).to_numpy().tolist()))
    assert text(found) == text(expected)


def test_melodies_are_spread_over_tasks(spark):
    """A file may be one row group, which one task reads."""
    rows = views.melodies(spark, SF).select("volpiano")
    assert "REPARTITION_BY_COL" in rows._jdf.queryExecution().executedPlan().toString()
    words = catalogue.queries()["tfidf_weights"]
    asked = []
    count = type(rows).count
    try:
        type(rows).count = lambda df: asked.append(df) or count(df)
        words(spark, SF)
    finally:
        type(rows).count = count
    assert len(asked) == 1 and "regexp_replace" not in asked[0]._jdf.queryExecution().optimizedPlan().toString()
    assert count(asked[0]) == count(views.melodies(spark, SF).where("volpiano is not null"))


def test_tsne_gives_every_row(spark):
    v = np.random.default_rng(3).normal(0, 1, (60, 4))
    df = spark.createDataFrame([(i, v[i % 60].tolist()) for i in range(120)], "id long, v array<double>").select("id", array_to_vector("v").alias("features"))
    got = {r.id: (r.x, r.y) for r in embed.tsne(df, perplexity=5, steps=100, most_rows=60).collect()}
    assert got.keys() == set(range(120)) and np.isfinite(list(got.values())).all()
    fitted = {r.id for r in df.orderBy(F.xxhash64("id")).limit(60).collect()}
    halves = [i for i in range(60) if (i in fitted) != (i + 60 in fitted)]  # the other of two equal rows stands where the fitted one is
    assert len(halves) > 10 and all(np.allclose(got[i], got[i + 60], atol=1e-3) for i in halves)
