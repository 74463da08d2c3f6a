import inspect
import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from gatherum.operators import neighbors
from gatherum.plans import grids, runner, store
from gatherum.plans.config import Experiment, Stage
from gatherum.sources import readers, sinks

SF = "/root/testdata/sf0.001"


def test_csv_json_and_news(spark, tmp_path):
    csv = tmp_path / "c.csv"
    csv.write_text('Text,Label\n"one, ""two""\nthree",1\nfour,0\n')
    rows = readers.read_labelled_csv(spark, str(csv)).orderBy("id").collect()
    assert [(r["document"], r["label"]) for r in rows] == [('one, "two"\nthree', 1), ("four", 0)]
    js = tmp_path / "q.jsonl"
    js.write_text('{"question": "why?", "answer": "so"}\n{"question": "how?"}\n')
    got = readers.read_questions_jsonl(spark, str(js), limit_to=1).collect()
    assert [(r["document"], r["label"]) for r in got] == [("why?", None)]
    for split, cat, name, body in (("train", "sci", "1", "h: x\n\nbody one"), ("test", "alt", "2", "h: y\n\nbody two")):
        folder = tmp_path / "news" / split / cat
        folder.mkdir(parents=True)
        (folder / name).write_text(body)
    paths = [str(tmp_path / "news" / s) for s in ("train", "test")]
    news = readers.read_news(spark, paths, clean=True).collect()
    assert {(r["document"], r["label"]) for r in news} == {("body one", 1), ("body two", 0)}
    only = readers.read_news(spark, paths, categories=["sci"]).collect()
    assert [r["label"] for r in only] == [0]
    with pytest.raises(ValueError):
        readers.read_news(spark, paths, limit_to=-1)


def test_results_replace_their_own_experiment(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_results(spark.range(3), path, "a")
    sinks.write_results(spark.range(5), path, "b")
    sinks.write_results(spark.range(1), path, "a")
    counts = {r["experiment"]: r["count"] for r in sinks.read_results(spark, path).groupBy("experiment").count().collect()}
    assert counts == {"a": 1, "b": 5}


def test_unknown_names_are_errors():
    with pytest.raises(ValueError):
        Experiment("x", Stage("bag"))
    with pytest.raises(ValueError):
        grids.grid("movies")
    Experiment("x", Stage("TFIDF"), Stage("SVD"), Stage("KMeans"))


def test_evaluated_run_and_comparison(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("text").alias("document"), F.col("lang").alias("label"))
    runs = grids.grid("labelled", n_components=10)[1:2] + [
        Experiment("DBSCAN", grids.TFIDF, Stage("svd", {"n_components": 10}), Stage("dbscan", {"eps": 1e-6, "min_samples": 500}))]
    rows = runner.run_grid(docs, runs, seeds=range(2)).collect()
    seeds = {(r["estimator"], r["metric"], r["seed"]) for r in rows}
    assert ("KMeans with SVD", "ari", 1) in seeds and ("DBSCAN", "ari", 1) not in seeds
    values = {(r["estimator"], r["metric"]): r["value"] for r in rows}
    assert values[("DBSCAN", "silhouette")] is None  # all noise: undefined, and the run goes on
    table = runner.comparison(spark.createDataFrame(rows, runner.METRIC_SCHEMA)).collect()
    assert [r["estimator"] for r in table] == ["DBSCAN", "KMeans with SVD"]
    assert table[1]["silhouette_std"] == 0.0


def test_a_stopped_run_goes_on(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("text").alias("document"), F.col("lang").alias("label"))
    kept, fits = store.StageStore(spark, str(tmp_path / "stages")), []
    fit, tfidf = runner.cluster, runner.fit_tfidf
    settings = {"seeds": range(1), "ks": [1, 3], "n_components": 5, "n_clusters": 3}

    def stops(workspace, experiment, seed=None):
        fits.append(experiment.name)
        if len(fits) == 3:
            raise RuntimeError("stopped")
        return fit(workspace, experiment, seed)

    monkeypatch.setattr(runner, "cluster", stops)
    with pytest.raises(RuntimeError):
        grids.run_all({"questions": docs, "embeddings": docs}, store=kept, **settings)
    before = kept.stored()
    assert len(fits) == 3 and len(before) == 6  # elbow, tf-idf, share, svd, two runs
    monkeypatch.setattr(runner, "fit_tfidf", None)  # features are not made again
    tables = grids.run_all({"questions": docs, "embeddings": docs}, store=kept, **settings)
    # the first two runs of the other grid are the same as those of this one
    assert len(fits) == 3 + 3 + 2 and before < kept.stored()
    assert tables["elbow"].count() == 2 and tables["questions"].count() == 5 and tables["embeddings"].count() == 4
    work = runner.Workspace(docs, kept)
    work.prepare(Experiment("x", grids.TFIDF, Stage("svd", {"n_components": 5})))
    assert 0 < next(iter(work.explained.values())) < 1
    monkeypatch.setattr(runner, "fit_tfidf", tfidf)
    other = runner.Workspace(docs.filter("id > 3"), kept)
    assert other.vectorise(grids.TFIDF).count() == docs.filter("id > 3").count()
    same = Stage("KMeans", {"random_state": 1, "n_jobs": 3})
    assert runner.canonical(same) == runner.canonical(Stage("kmeans", {"seed": 1}))


def test_settings_of_the_usual_library_are_taken(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(
        F.col("doc_id").alias("id"), F.col("text").alias("document"), F.col("lang").alias("label"))
    work = runner.Workspace(docs)
    svd = Stage("svd", {"n_components": 5})
    models = [
        Stage("KMeans", {"n_clusters": 3, "max_iter": 5, "n_init": 2, "random_state": 4}),
        Stage("MiniBatchKMeans", {"n_clusters": 3, "init_size": 100, "batch_size": 100, "n_init": 1}),
        Stage("agglomerative", {"linkage": "ward", "metric": "euclidean", "n_clusters": 3}),
    ]
    for model in models:
        assert runner.cluster(work, Experiment("x", grids.TFIDF, svd, model)).count() == 200
    hashed = Stage("embedding", {"embed_batch_size": 8, "embed_device": "cpu", "embed_max_seq_length": 256})
    assert work.vectorise(hashed).count() == 200
    for bad in ({"linkage": "single"}, {"metric": "cosine"}):
        with pytest.raises(ValueError):
            runner.settings(Stage("agglomerative", bad))


def test_more_starts_never_cost_more(spark):
    from gatherum.operators import kmeans
    from gatherum.functions.vectors import from_arrays

    x = from_arrays(spark.read.parquet(f"{SF}/embeddings.parquet"), "vec_id", "embedding").cache()
    assert kmeans.kmeans(x, 6, 3, seed=2, n_init=3).wcss <= kmeans.kmeans(x, 6, 3, seed=2).wcss


def test_entry_and_registry(spark):
    found = entry_points.entry(spark).collect()
    assert len(found) == 4 and sum(r["size"] for r in found) == 200
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_no_cross_join_in_the_neighbour_plans(spark):
    x = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    from gatherum.functions.vectors import from_arrays

    space = neighbors.build_space(from_arrays(x, "id", "embedding"), block_rows=64)
    asked = space.points.select("id", "x", "cell", F.lit(1.0).alias("radius"))
    plan = neighbors.route(space, asked)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_no_local_checkpoint_in_the_package():
    root = os.path.dirname(inspect.getfile(entry_points))
    for folder, _dirs, files in os.walk(os.path.join(root, "gatherum")):
        for name in files:
            if name.endswith(".py"):
                body = open(os.path.join(folder, name)).read()
                assert not re.search(r"localCheckpoint|crossJoin|CROSS JOIN.*gaps", body), name
