"""Places where a user's models plug in, as batch functions over DataFrames.

Nothing here contains a model. The stand-ins are deterministic, for tests.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelight.functions import text as T


def encode_text(
    df: DataFrame, encoder: Callable[[list[str]], np.ndarray], text: str = "text", out: str = "embedding",
    prefix: str = "",
) -> DataFrame:
    """Adds unit vectors of a text column. ``prefix`` is put before texts that do not have it."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` array<float>"

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            texts = [t if t.startswith(prefix) else prefix + t for t in pdf[text].fillna("").str.strip()]
            yield pdf.assign(**{out: list(_unit(encoder(texts)))})

    return df.mapInPandas(run, schema)


def encode_prompts(queries: DataFrame, encoder, text: str = "text") -> DataFrame:
    """query_id, embedding: mean of the prompt ensemble of a query."""
    from cuelight.operators.dense import mean_vectors

    prompts = queries.select("query_id", F.explode(T.prompts(text)).alias("prompt"))
    return mean_vectors(encode_text(prompts, encoder, "prompt"), ["query_id"])


def encode_images(df: DataFrame, encoder: Callable[[list[bytes]], np.ndarray], key: str = "path", content: str = "content") -> DataFrame:
    """key, embedding from binary files, batch by batch."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, embedding array<float>"

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "embedding": list(_unit(encoder(list(pdf[content]))))})

    return df.select(key, content).mapInPandas(run, schema)


def pair_scorer(score: Callable[[list[str], list[str]], np.ndarray]) -> Callable[[Column, Column], Column]:
    """A scorer for reranking; a batch on which the model fails scores null."""

    @F.pandas_udf("double")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        try:
            return pd.Series(np.asarray(score(list(q), list(t)), dtype=float))
        except Exception:
            return pd.Series([None] * len(q), dtype="float64")

    return run


def media_rows(df: DataFrame, extract: Callable[[bytes], list[dict]], schema: str, key: str = "path", content: str = "content") -> DataFrame:
    """Rows (segments, lines, frames) that a user function makes from each media file."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches):
        for pdf in batches:
            rows = [{key: k, **r} for k, c in zip(pdf[key], pdf[content]) for r in extract(c)]
            yield pd.DataFrame(rows, columns=[key, *names])

    return df.select(key, content).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, {schema}")


def generate(
    df: DataFrame, clients: list[Callable[[str], str]], prompt: str = "prompt", retries: int = 2, key: str = "query_id",
) -> DataFrame:
    """key, output, attempts, error: each client is tried ``retries`` + 1 times, then the next one."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            out = []
            for k, p in zip(pdf[key], pdf[prompt]):
                text, tries, error = None, 0, None
                for client in clients:
                    for _ in range(retries + 1):
                        tries += 1
                        try:
                            text = client(p)
                        except Exception as e:  # a client may fail in any way
                            error = str(e)
                        if text:
                            break
                    if text:
                        break
                out.append((k, text, tries, None if text else error or "empty"))
            yield pd.DataFrame(out, columns=[key, "output", "attempts", "error"])

    return df.select(key, prompt).mapInPandas(run, f"`{key}` {kind}, output string, attempts int, error string")


def _unit(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, dtype=np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return (m / np.where(n > 0, n, 1.0)).astype(np.float32)


def hashing_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Stand-in text encoder: signed counts of hashed words."""

    def run(texts):
        m = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                m[i, h % dim] += 1 if h & 0x80000000 else -1
        return m

    return run


def byte_encoder(dim: int = 64) -> Callable[[list[bytes]], np.ndarray]:
    """Stand-in image encoder: byte histogram."""

    def run(contents):
        return np.array([np.bincount(np.frombuffer(c, dtype=np.uint8) % dim, minlength=dim) for c in contents], dtype=float).reshape(len(contents), dim)

    return run
