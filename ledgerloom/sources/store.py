"""Saving fitted models: parameters as a one-row table, Spark ML models in their own format."""

from __future__ import annotations

import dataclasses
import json

import numpy as np
from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import SparkSession

from ledgerloom.operators import behaviour, boosting, glm, histogram_trees, kmeans, models, segments
from ledgerloom.operators.design import Design, FittedDesign

KINDS = {c.__name__: c for c in (
    models.Prevalence, models.LogisticModel, models.TreeClassifier, models.PurchaseHazard, models.Platt,
    models.WeeklyNetwork, models.RevenueGlm, models.TreeRegressor, models.LogNormalHurdle,
    behaviour.BetaGeoNbd, behaviour.GammaGamma, behaviour.ParetoNbd, boosting.LogLinkBoosting, boosting.BoostedHurdle,
    glm.LinearScore, histogram_trees.HistogramTrees, kmeans.Centres, segments.DiagonalMixture, segments.SegmentSpace)}


def _plain(value):
    if isinstance(value, np.ndarray):
        return {"array": value.tolist()}
    if isinstance(value, FittedDesign):
        return {"fitted": {**{f.name: getattr(value, f.name) for f in dataclasses.fields(value)},
                           "design": dataclasses.asdict(value.design)}}
    if isinstance(value, Design):
        return {"design": dataclasses.asdict(value)}
    if isinstance(value, list) and value and all(isinstance(v, dict) for v in value):
        return {"tables": [[[k, float(x)] for k, x in sorted(v.items())] for v in value]}  # leaf values per tree
    return value.item() if isinstance(value, np.generic) else value


def _design(fields: dict) -> Design:
    return Design(**{k: tuple(v) if isinstance(v, list) else v for k, v in fields.items()})


def _restored(value):
    if isinstance(value, dict) and set(value) == {"array"}:
        return np.array(value["array"])
    if isinstance(value, dict) and set(value) == {"tables"}:
        return [{int(k): x for k, x in table} for table in value["tables"]]
    if isinstance(value, dict) and set(value) == {"design"}:
        return _design(value["design"])
    if isinstance(value, dict) and set(value) == {"fitted"}:
        fields = {k: tuple(v) if isinstance(v, list) else v for k, v in value["fitted"].items()}
        pairs = {k: {n: tuple(p) for n, p in fields[k].items()} for k in ("ranges", "scaling")}
        return FittedDesign(**{**fields, **pairs, "design": _design(value["fitted"]["design"])})
    return value


def save_model(spark: SparkSession, model, path: str) -> None:
    """Write a fitted model of any kind in ``KINDS`` under ``path``, with the models that it holds."""
    plain, parts = {}, []
    for name, value in vars(model).items():
        held = value if isinstance(value, list) and value and all(isinstance(v, Model) for v in value) else [value]
        if type(value).__name__ in KINDS:
            save_model(spark, value, f"{path}/{name}")
            parts.append(f"{name}:kind")
        elif all(isinstance(v, Model) for v in held):
            for i, part in enumerate(held):
                part.write().overwrite().save(f"{path}/{name}/{i}")
            parts.append(f"{name}:{len(held) if held is value else 'one'}")
        else:
            plain[name] = _plain(value)
    row = (type(model).__name__, json.dumps(plain), parts)
    spark.createDataFrame([row], "kind string, parameters string, parts array<string>").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/parameters")


def load_model(spark: SparkSession, path: str):
    row = spark.read.parquet(f"{path}/parameters").first()  # one row
    model = object.__new__(KINDS[row["kind"]])
    for name, value in json.loads(row["parameters"]).items():
        setattr(model, name, _restored(value))
    for part in row["parts"]:
        name, how = part.rsplit(":", 1)
        read = lambda i: DefaultParamsReader.loadParamsInstance(f"{path}/{name}/{i}", spark)  # noqa: B023, E731
        setattr(model, name, load_model(spark, f"{path}/{name}") if how == "kind" else read(0) if how == "one" else [read(i) for i in range(int(how))])
    return model
