"""Datasets and experiments: condition grids, tuning, training, evaluation."""

from __future__ import annotations

import itertools

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from neumatic.functions import features, neume, represent, segment
from neumatic.operators import embed, filters, metrics, models, split, tfidf
from neumatic.sources import tables

GENRES, SUBSETS, SPLITS = ("responsory", "antiphon"), ("full", "subset"), ("train", "test")
GENRE_IDS = {"responsory": "genre_r", "antiphon": "genre_a"}
REPRESENTATIONS = ("pitch", "interval-dependent", "interval-independent", "contour-dependent", "contour-independent")
SEGMENTATIONS = ("neumes", "syllables", "words", *(f"{k}-mer" for k in segment.KMERS), *(f"poisson-{m}" for m in segment.POISSON_MEANS))
GRIDS = {
    "traditional": {"feature_set": tuple(features.FEATURE_SETS), "genre": GENRES, "subset": SUBSETS},
    "profile": {"profile": tuple(features.PROFILES), "genre": GENRES, "subset": SUBSETS},
    "tfidf": {"classifier": ("linear_svc",), "genre": GENRES, "subset": SUBSETS, "representation": REPRESENTATIONS, "segmentation": SEGMENTATIONS},
}
PLURALS = {"feature_set": "feature_sets", "profile": "profiles", "classifier": "classifiers", "genre": "genres", "subset": "subsets", "representation": "representations", "segmentation": "segmentations"}
TRAIN_SHARE = 0.7


def conditions(kind: str, **chosen) -> list[dict]:
    """Every combination of the grid; each axis is 'all' or a list."""
    axes = {axis: all_ if chosen.get(PLURALS[axis], "all") == "all" else tuple(chosen[PLURALS[axis]]) for axis, all_ in GRIDS[kind].items()}
    return [dict(zip(axes, values)) for values in itertools.product(*axes.values())]


def units_table(melodies: DataFrame, seed: int = 0) -> DataFrame:
    """(id, segmentation, units) of every segmentation, from (id, processed)."""
    names = segment.segmentations(F.col("processed"))
    for mean in segment.POISSON_MEANS:  # null without notes: no row
        names[f"poisson-{mean}"] = F.transform(segment.poisson_units(F.col("id"), neume.notes_only(F.col("processed")), mean, seed + mean), lambda u: u["unit"])
    wide = melodies.select("id", *(c.alias(n) for n, c in names.items()))
    long = wide.select("id", F.explode(F.create_map(*(x for n in names for x in (F.lit(n), F.col(f"`{n}`"))))).alias("segmentation", "units"))
    return long.where("units is not null")


def representations_table(units: DataFrame) -> DataFrame:
    """(id, segmentation, representation, units) of all five representations."""
    u = F.col("units")
    kinds = {"pitch": u} | {f"{kind}-{'dependent' if dep else 'independent'}": represent.representation(u, kind, dep) for kind in ("interval", "contour") for dep in (True, False)}
    pairs = F.create_map(*(x for name, c in kinds.items() for x in (F.lit(name), c)))
    return units.select("id", "segmentation", F.explode(pairs).alias("representation", "units"))


def features_table(melodies: DataFrame) -> DataFrame:
    """All 88 feature columns, from (id, processed)."""
    # generators keep the optimizer from copying the expressions into each of the columns
    coded = melodies.select("id", F.explode(F.array(represent.pitch_string(neume.notes_only(F.col("processed"))))).alias("coded"))
    coded = coded.select("id", "coded", F.explode(F.array(features.repeated(F.col("coded")))).alias("again"))
    notes = coded.select("id", "coded", "again", F.explode(F.array(F.transform(F.filter(F.split("coded", ""), lambda c: c != ""), F.ascii))).alias("notes"))
    return notes.select("id", *(c.alias(n) for n, c in features.all_features(F.col("notes"), F.col("coded"), F.col("again")).items()))


def generate(chants: DataFrame, genre_id: str, one_per_family: bool, seed: int) -> DataFrame:
    """Filtered chants with their processed melody and split."""
    kept = filters.filter_chants(chants, genre_id, one_per_family, seed)
    done = split.exact_sample(kept, TRAIN_SHARE, seed + 1)
    return done.withColumn("processed", neume.process(F.col("volpiano"))).withColumn("split", F.when(F.col("is_train"), "train").otherwise("test"))


def generate_datasets(chants: DataFrame, path: str, seed: int = 0, genre_ids: dict[str, str] = GENRE_IDS) -> None:
    """The four datasets, with seeds seed to seed + 3, as partitioned Parquet: chants, representations, features."""
    for k, (genre, subset) in enumerate((g, s) for g in GENRES for s in SUBSETS):
        own = f"genre={genre}/subset={subset}"
        done = generate(chants, genre_ids[genre], subset == "subset", seed + k)
        done.write.mode("overwrite").partitionBy("split").parquet(f"{path}/chants/{own}")
        # what follows reads the melodies written, so that they are not derived again for each table
        done = chants.sparkSession.read.parquet(f"{path}/chants/{own}").select("id", "processed", "split")
        part = done.select("id", "split")
        units = representations_table(units_table(done, seed + k)).join(part, "id")
        units.write.mode("overwrite").partitionBy("split", "representation", "segmentation").parquet(f"{path}/representations/{own}")
        features_table(done).join(part, "id").write.mode("overwrite").partitionBy("split").parquet(f"{path}/features/{own}")


def load(spark: SparkSession, data_dir: str, kind: str, condition: dict, part: str) -> DataFrame:
    """(id, label, features or units) of one condition and split; joined by key."""
    own = f"genre={condition['genre']}/subset={condition['subset']}/split={part}"
    target = spark.read.parquet(f"{data_dir}/chants/{own}").select("id", (F.col("mode").cast("int") - 1).cast("double").alias("label"))
    if kind == "tfidf":
        rows = spark.read.parquet(f"{data_dir}/representations/{own}").where((F.col("representation") == condition["representation"]) & (F.col("segmentation") == condition["segmentation"])).select("id", "units")
    else:
        names = features.FEATURE_SETS[condition["feature_set"]] if kind == "traditional" else features.PROFILES[condition["profile"]]
        wide = spark.read.parquet(f"{data_dir}/features/{own}").select("id", *names).fillna(0.0)
        rows = VectorAssembler(inputCols=names, outputCol="features").transform(wide).select("id", "features")
    return target.join(rows, "id")


CLASSIFIER = {"traditional": "random_forest", "profile": "knn", "tfidf": "linear_svc"}


def run_condition(spark: SparkSession, data_dir: str, results_dir: str, kind: str, condition: dict, n_iter: int = 100, n_splits: int = 5, seed: int = 0, space: dict | None = None) -> list[dict]:
    """Tune, train on all training rows, and write tuning results and both splits' predictions."""
    name = f"{results_dir}/{'-'.join(str(v) for v in condition.values())}"
    train, test = (load(spark, data_dir, kind, condition, part).cache() for part in SPLITS)
    classifier = condition.get("classifier", CLASSIFIER[kind])
    folded = split.stratified_folds(train, "label", n_splits, seed).cache()
    prepare = (lambda rows: tfidf.fit_vectorizer(rows).transform) if kind == "tfidf" else None
    tuned = models.tune(folded, classifier, n_iter, seed, space=space, prepare=prepare)
    tables.write_rows(spark, tuned, f"{name}-tuning.csv")
    change = lambda rows: rows
    if kind == "tfidf":
        vectorizer = tfidf.fit_vectorizer(train)
        vectorizer.save(f"{name}-vectorizer")
        change = vectorizer.transform
    model = models.train_best(change(train), classifier, tuned)
    models.save(model, f"{name}-model", spark)
    for part, rows in zip(SPLITS, (train, test)):
        tables.write_predictions(model.predict(change(rows)), f"{name}-{part}-pred.txt")
    for df in (train, test, folded):
        df.unpersist()
    return tuned


def evaluate_condition(spark: SparkSession, data_dir: str, results_dir: str, kind: str, condition: dict) -> dict:
    """Scores of one condition from its written predictions."""
    name = f"{results_dir}/{'-'.join(str(v) for v in condition.values())}"
    out = dict(condition)
    for part in SPLITS:
        pairs = spark.read.parquet(f"{name}-{part}-pred.txt.parquet")
        out |= {f"{part}_{k}": v for k, v in metrics.scores(pairs).first().asDict().items()}
    return out


def run(spark: SparkSession, experiment_type: str, data_dir: str, results_dir: str, n_iter: int = 100, n_splits: int = 5, random_state: int = 0, **settings) -> None:
    for condition in conditions(experiment_type, **settings):
        run_condition(spark, data_dir, results_dir, experiment_type, condition, n_iter, n_splits, random_state)


def evaluate(spark: SparkSession, experiment_type: str, data_dir: str, results_dir: str, **settings) -> list[dict]:
    rows = [evaluate_condition(spark, data_dir, results_dir, experiment_type, c) for c in conditions(experiment_type, **settings)]
    tables.write_rows(spark, rows, f"{results_dir}/scores.csv")
    return rows


EMBEDDERS = {"pca": embed.pca, "svd": lambda rows: embed.svd(rows).select("id", F.get("v", F.lit(0)).alias("x"), F.get("v", F.lit(1)).alias("y")), "tsne": embed.tsne}


def embed_condition(spark: SparkSession, data_dir: str, results_dir: str, condition: dict, embedder: str, part: str, rows: int | None = None, refresh: bool = False) -> str:
    """Write x, y and label of one condition's tf-idf vectors by id; an existing result stays unless ``refresh``.

    ``rows`` embeds the first rows by id only; without it, all.
    """
    path = f"{results_dir}/embeddings/{condition['genre']}/{condition['subset']}/{condition['representation']}/{embedder}-{part}-{condition['segmentation']}.csv"
    if refresh or not tables.exists(spark, path):
        data = load(spark, data_dir, "tfidf", condition, part)
        data = data if rows is None else split.head(data, rows)
        found = EMBEDDERS[embedder](tfidf.fit_vectorizer(data).transform(data))
        labels = data.select("id", (F.col("label") + 1).cast("int").alias("mode"))
        tables.write_embedding(labels.join(found, "id"), path, refresh=True)
    return path


def run_embeddings(spark: SparkSession, data_dir: str, results_dir: str, embedders="all", splits="all", rows: int | None = None, refresh: bool = False, **settings) -> list[str]:
    """Every condition, embedder and split asked for."""
    embedders, splits = (all_ if chosen == "all" else chosen for chosen, all_ in ((embedders, EMBEDDERS), (splits, SPLITS)))
    chosen = {k: v for k, v in settings.items() if k in PLURALS.values() and k != "classifiers"}
    return [embed_condition(spark, data_dir, results_dir, c, e, p, rows, refresh) for c in conditions("tfidf", **chosen) for e in embedders for p in splits]
