"""Vectors as array columns; everything built in except the embedding itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """A zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x / norm))


def cosine_max(v: Column, roles: list[list[float]]) -> tuple[Column, Column]:
    """(largest dot product, index of the first role that has it); no roles give (0.0, -1)."""
    if not roles:
        return F.lit(0.0), F.lit(-1)
    sims = F.array(*(dot(v, F.lit([float(x) for x in r])) for r in roles))
    best = F.array_max(sims)
    return best, (F.array_position(sims, best) - 1).cast("int")


def cache_key(model: Column, dim: int, task: str, text: Column) -> Column:
    """Key of a text's vector: equal texts share it across profiles and runs."""
    return F.sha2(F.concat_ws("|", model, F.lit(str(dim)), F.lit(task), text), 256)


class HashingEmbedder:
    """Deterministic default: hashed words and word pairs, signed, normalised.

    Any object with `name`, `dim` and `embed(texts)` can take its place.
    """

    def __init__(self, dim: int = 256):
        self.dim = dim
        self.name = f"hashing-{dim}"

    def embed(self, texts: list[str]) -> np.ndarray:
        import re
        import zlib

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, text in enumerate(texts):
            words = re.findall(r"\w+", text.lower())
            for gram in words + [f"{a} {b}" for a, b in zip(words, words[1:])]:
                h = zlib.crc32(gram.encode())
                out[i, h % self.dim] += 1.0 if h & 0x80000000 else -1.0
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norms == 0, 1, norms)


def choose_embedder(makers: list, log=None):
    """The first embedder of `makers` (functions without arguments) that can be made and embeds a probe.

    The choice falls on the driver, before a job starts, and holds for the whole run: vectors of two models
    never mix. `log` is told of each that fails; without one that works the last error is raised.
    """
    error: Exception | None = None
    for make in makers:
        try:
            embedder = make()
            if len(embedder.embed(["probe"])[0]) == embedder.dim:
                return embedder
            raise ValueError(f"{embedder.name} gives vectors of another length than {embedder.dim}")
        except Exception as e:  # whatever a model's own code raises
            error = e
            if log is not None:
                log(f"{getattr(make, '__name__', make)}: {e}")
    raise RuntimeError("no embedder works") from error


def embed_udf(embedder):
    """A vector for each text; the embedder is sent once and used batch by batch."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(list(embedder.embed([t or " " for t in s])))

    return embed
