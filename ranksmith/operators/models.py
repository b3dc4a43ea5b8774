"""Models behind one registry: embedding, sparse-encoding and scoring functions, run as Arrow-batched pandas UDFs."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: kind -> Spark type of a result.
KINDS = {"dense": "array<float>", "sparse": "map<string,double>", "score": "double", "spans": "array<struct<start:int,end:int>>"}


@dataclass(frozen=True)
class Model:
    """``function`` takes a list of inputs and returns a list of results; ``load`` (optional) makes it, once in each worker."""

    name: str
    kind: str
    function: Callable | None = None
    load: Callable[[], Callable] | None = None
    query_function: Callable | None = None
    dimension: int | None = None
    model_type: str = "dense"


@dataclass
class ModelRegistry:
    models: dict[str, Model] = field(default_factory=dict)

    def register(self, model_id: str, model: Model) -> None:
        if model.kind not in KINDS:
            raise ValueError(f"unknown model kind {model.kind!r}")
        if model.function is None and model.load is None:
            raise ValueError("a model needs a function or a loader")
        self.models[model_id] = model

    def get(self, model_id: str) -> Model:
        if model_id not in self.models:
            raise ValueError(f"unknown model {model_id!r}")
        return self.models[model_id]

    def column(self, model_id: str, *inputs: Column, query: bool = False, batch_size: int | None = None) -> Column:
        """A model's results for input columns. Null inputs reach the model as None only if another input is there.

        The model gets a whole Arrow batch at a time, or ``batch_size`` inputs."""
        model = self.get(model_id)
        function, load = (model.query_function if query and model.query_function else model.function), model.load

        def batches(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            run = function or load()
            for part in parts:
                rows = list(zip(*[p.where(p.notna(), None) for p in part]))
                have = [i for i, r in enumerate(rows) if any(x is not None for x in r)]
                have.sort(key=lambda i: sum(len(str(x)) for x in rows[i] if x is not None))  # texts of a length together
                out: list = [None] * len(rows)
                step = batch_size or max(1, len(have))
                for lo in range(0, len(have), step):
                    now = have[lo : lo + step]
                    for i, x in zip(now, run([rows[i] if len(part) > 1 else rows[i][0] for i in now])):
                        out[i] = x
                yield pd.Series(out, dtype=object)

        if len(inputs) == 1:

            def single(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
                return batches((p,) for p in parts)

            single.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
            return F.pandas_udf(single, KINDS[model.kind])(*inputs)
        batches.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
        return F.pandas_udf(batches, KINDS[model.kind])(*inputs)

    def list_column(self, model_id: str, texts: Column, batch_size: int | None = None) -> Column:
        """A model's results for each text of a list column, in order; null for blank ones, and for a null list."""
        model = self.get(model_id)
        function, load = model.function, model.load

        def lists(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            run = function or load()
            for part in parts:
                rows = [[] if x is None else list(x) for x in part]
                have = [(i, j) for i, row in enumerate(rows) for j, x in enumerate(row) if x is not None and x.strip()]
                have.sort(key=lambda p: len(rows[p[0]][p[1]]))  # texts of a length together
                out: list = [None if x is None else [None] * len(x) for x in part]
                step = batch_size or max(1, len(have))
                for lo in range(0, len(have), step):
                    now = have[lo : lo + step]
                    for (i, j), v in zip(now, run([rows[i][j] for i, j in now])):
                        out[i][j] = v
                yield pd.Series(out, dtype=object)

        lists.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(lists, f"array<{KINDS[model.kind]}>")(texts)

    def encode_query(self, model_id: str, *inputs):
        """A model's result for one query, on the driver."""
        model = self.get(model_id)
        run = model.query_function or model.function or model.load()
        return run([inputs if len(inputs) > 1 else inputs[0]])[0]


def hashing_encoder(dimension: int = 64, seed: int = 0) -> Callable[[list], list]:
    """A deterministic stand-in for an embedding model: signed hashed token counts, scaled to length one."""

    def run(texts: list) -> list:
        out = []
        for text in texts:
            parts = [p for p in (text if isinstance(text, tuple) else (text,)) if p is not None]
            v = np.zeros(dimension)
            for token in " ".join(map(str, parts)).lower().split():
                h = int.from_bytes(hashlib.blake2b(f"{seed}|{token}".encode(), digest_size=8).digest(), "big")
                v[h % dimension] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).astype(np.float32).tolist())
        return out

    return run


def retry(call: Callable, times: int = 3, first_wait: float = 0.5, transient: tuple[type[Exception], ...] = (ConnectionError, TimeoutError), sleep=time.sleep):
    """Call again after transient errors, waiting twice as long each time."""
    for attempt in range(times + 1):
        try:
            return call()
        except transient:
            if attempt == times:
                raise
            sleep(first_wait * 2**attempt)
