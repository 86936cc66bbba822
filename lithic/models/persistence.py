"""Models as JSON: classes of this package by name, their state, arrays in base 64."""

from __future__ import annotations

import base64
import importlib
import json

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

PACKAGE = "lithic."


def to_spec(x):
    if isinstance(x, np.ndarray):
        return {"array": base64.b64encode(np.ascontiguousarray(x).tobytes()).decode(), "dtype": x.dtype.str, "shape": list(x.shape)}
    if isinstance(x, (np.floating, np.integer)):
        return x.item()
    if isinstance(x, (list, tuple)):
        return {"items": [to_spec(v) for v in x], "tuple": isinstance(x, tuple)}
    if isinstance(x, dict):
        return {"map": [[to_spec(k), to_spec(v)] for k, v in x.items()]}
    if x is None or isinstance(x, (str, int, float, bool)):
        return {"value": x} if isinstance(x, dict) else x
    if not type(x).__module__.startswith(PACKAGE):
        raise TypeError(f"can't save a {type(x)}")
    return {"class": f"{type(x).__module__}:{type(x).__qualname__}", "state": {k: to_spec(v) for k, v in vars(x).items()}}


def from_spec(s):
    if not isinstance(s, dict):
        return s
    if "array" in s:
        return np.frombuffer(base64.b64decode(s["array"]), s["dtype"]).reshape(s["shape"]).copy()
    if "items" in s:
        return (tuple if s["tuple"] else list)(from_spec(v) for v in s["items"])
    if "map" in s:
        return {from_spec(k): from_spec(v) for k, v in s["map"]}
    module, name = s["class"].split(":")
    if not module.startswith(PACKAGE):
        raise ValueError(f"not a class of this package: {s['class']}")
    kind = getattr(importlib.import_module(module), name)
    out = kind.__new__(kind)
    vars(out).update({k: from_spec(v) for k, v in s["state"].items()})
    return out


def save_model(spark: SparkSession, model, path: str) -> None:
    """Written by Spark, so any file system that it reaches will do."""
    spark.range(1).select(F.lit(json.dumps(to_spec(model))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str):
    return from_spec(json.loads(spark.read.text(path).first()[0]))
