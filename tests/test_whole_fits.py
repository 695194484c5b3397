"""The model queries fit every learner they name, as the library has it."""

from metaprism.operators import models as E
from metaprism.operators import runlog
from metaprism.plans import q_models, q_runs

from paths import SF0001


def _record(monkeypatch):
    """Fits are noted and fail, so only what is asked for is seen."""
    seen = []

    def fit(name, fr, seed=42, **params):
        seen.append((name, params))
        raise ValueError("not fitted here")
    monkeypatch.setattr(E, "fit_classifier", fit)
    return seen


def test_scores_use_the_defaults(spark, monkeypatch):
    seen = _record(monkeypatch)
    got = {r["model"]: r["status"] for r in q_models.q_model_scores(spark, SF0001).collect()}
    assert sorted(seen) == [(n, {}) for n in sorted(q_models.CLASSIFIERS)]
    assert got == {n: "CRASH" for n in q_models.CLASSIFIERS} | {"knn": "OK"}


def test_runs_use_the_defaults(spark, monkeypatch):
    from metaprism.operators import neighbourhood
    from metaprism.plans import extract

    def vote(tr, df, k):
        seen.append(("knn", {}))
        raise ValueError("not fitted here")
    monkeypatch.setattr(neighbourhood, "knn_predict", vote)
    monkeypatch.setattr(extract, "extract", lambda fr, **kw: spark.createDataFrame([("n", 1.0)], "name string, value double"))
    monkeypatch.setattr(runlog, "phase_chain", lambda train, valid, pipeline, task: (train, valid, None, None))
    seen = _record(monkeypatch)
    log = q_runs.q_run_experiment(spark, SF0001).select("num_pipeline", "num_modelo", "nombre_modelo").distinct().collect()
    _, models = runlog.sample_pipelines(spark, 10, "clasificacion")
    ran = {r["num_pipeline"] for r in log if r["num_modelo"] > 0}
    want = [r for r in models.collect() if r["num_pipeline"] in ran]
    assert {r["num_pipeline"] for r in log} == set(range(1, 11)) and ran
    assert sorted(n for n, _ in seen) == sorted(r["model"] for r in want for _ in range(3))
    assert all(p == {} for _, p in seen)
    assert {(r["num_pipeline"], r["num_modelo"]) for r in log if r["num_modelo"] > 0} == {(r["num_pipeline"], r["num_modelo"]) for r in want}
