"""Scores of models as attributes of objects."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.spec.expr import SpecError
from eventloom.spec.model import Model

#: FNV-1a with 64 bits: fixed values of the published hash.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def _fnv(state: np.ndarray, data: bytes | np.ndarray) -> np.ndarray:
    """Feeds the same bytes, or a column of bytes for each state, into all states."""
    columns = [np.uint64(b) for b in data] if isinstance(data, bytes) else list(data.T.astype(np.uint64))
    with np.errstate(over="ignore"):
        for byte in columns:
            state = (state ^ byte) * np.uint64(FNV_PRIME)
    return state


def mock_scores(model: str, tensors: list[tuple[str, np.ndarray]]) -> np.ndarray:
    """A score in [0, 1) for each row from the bytes of the model's name and of its inputs (name, (rows, width) of float32)."""
    rows = len(tensors[0][1])
    state = _fnv(np.full(rows, FNV_START, dtype=np.uint64), model.encode())
    for name, values in tensors:
        state = _fnv(_fnv(state, name.encode()), b"F32")
        for size in values.shape[1:]:
            state = _fnv(state, struct.pack("<Q", size))
        flat = np.ascontiguousarray(values.astype("<f4")).reshape(rows, -1)
        state = _fnv(state, flat.view(np.uint8).reshape(rows, -1))
    return (state % np.uint64(1_000_000)).astype(np.float32) / np.float32(1_000_000)


def features(frame: pd.DataFrame) -> np.ndarray:
    """Columns as a row-major float32 matrix."""
    return np.column_stack([frame[c].to_numpy(dtype=np.float32) for c in frame.columns]) if len(frame.columns) else np.zeros((len(frame), 0), np.float32)


def add_scores(df: DataFrame, model: Model) -> DataFrame:
    """Adds the score to each object of the model's batch collection; scores are computed for whole Arrow batches."""
    if model.provider.get("kind", "mock") != "mock":
        raise SpecError("InvalidProvider", model.name, "only the mock provider runs here")
    batch, name = model.batch, model.name
    attrs = [i.split("_", 1)[1] for i in model.inputs]
    out = model.output.split("_", 1)[1]

    @F.pandas_udf("array<float>")
    def scores(*columns: pd.Series) -> pd.Series:
        sizes = [len(x) for x in columns[0]]
        if not sum(sizes):
            return pd.Series([[] for _ in sizes])
        matrix = np.stack([np.concatenate([np.asarray(x, dtype=np.float32) for x in c]) for c in columns], axis=1)
        values = mock_scores(name, [("features", matrix)])
        return pd.Series(np.split(values, np.cumsum(sizes)[:-1]))

    got = scores(*[F.col(batch)[a].cast("array<float>") for a in attrs])
    scored = df.withColumn("__scores", got)
    return scored.withColumn(batch, F.transform(batch, lambda x, i: x.withField(out, F.get("__scores", i)))).drop("__scores")
