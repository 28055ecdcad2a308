"""Dense scores: embedders, the embedding table with its cache, and cosine top-k within a sample."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from recallery.functions import metrics as M
from recallery.functions import text as X
from recallery.operators import nearest
from recallery.operators.clients import WINDOW, in_order, retrying
from recallery.sources.ship import ship

DIMENSION = 64


def hashed_embedder(texts: list[str], role: str = "context", dimension: int = DIMENSION) -> np.ndarray:
    """The offline default: signed counts of hashed tokens. The role makes no difference here."""
    out = np.zeros((len(texts), dimension), np.float32)
    for i, text in enumerate(texts):
        for token in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
            out[i, h % dimension] += 1.0 if h >> 63 else -1.0
    return out


@dataclass(frozen=True)
class Encoder:
    """A model of embeddings: its name, the function (texts, role) -> vectors, their length, how many texts go at a time,
    whether it encodes questions by another encoder than texts, and how many calls of a task may be under way at a time."""

    model: str = "hashed"
    embedder: Callable[[list[str], str], np.ndarray] = hashed_embedder
    dim: int = DIMENSION
    batch: int = 16
    dual: bool = False
    window: int = 1

    @property
    def query_role(self) -> str:
        """The role of a question: its own only for a dual encoder, so that others share one cache entry with equal texts."""
        return "query" if self.dual else "context"


def api_encoder(model: str, call: Callable[[list[str]], np.ndarray], dim: int, batch: int = 10, attempts: int = 10, sleep: Callable[[float], None] | None = None) -> Encoder:
    """An encoder behind an interface that may fail: small batches, several under way, each tried again with growing pauses."""
    return Encoder(model, lambda texts, role: retrying(call, attempts, sleep=sleep)(texts), dim, batch, window=WINDOW)


def dual_encoder(model: str, query: Callable[[list[str]], np.ndarray], context: Callable[[list[str]], np.ndarray], dim: int, batch: int = 16) -> Encoder:
    return Encoder(model, lambda texts, role: query(texts) if role == "query" else context(texts), dim, batch, True)


def embed(df: DataFrame, text: str, model: str = "hashed", embedder: Callable[[list[str], str], np.ndarray] = hashed_embedder, role: str = "context", batch: int = 16, window: int = 1) -> DataFrame:
    """(text_digest, model, role, dim, vec) of the distinct texts of a column, vectors of length 1. Up to ``window`` calls
    of the embedder are under way in a task."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            texts = pdf["_t"].tolist()
            parts, asks = [], [texts[k : k + batch] for k in range(0, len(texts), batch)]
            for asked, (told, failed) in zip(asks, in_order(lambda x: embedder(x, role), asks, window), strict=True):
                if failed is not None:
                    raise failed
                got = np.asarray(told, np.float32)
                if got.ndim != 2 or len(got) != len(asked):
                    raise ValueError(f"{len(asked)} texts gave vectors of shape {got.shape}")
                parts.append(got)
            x = np.vstack(parts) if parts else np.zeros((0, 1), np.float32)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({"text_digest": pdf["text_digest"], "dim": x.shape[1], "vec": list(x.astype(np.float32))})

    ship(df.sparkSession)
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("_t")).distinct().withColumn("text_digest", X.digest("_t"))
    done = texts.mapInPandas(run, "text_digest string, dim int, vec array<float>")
    return done.select("text_digest", F.lit(model).alias("model"), F.lit(role).alias("role"), "dim", "vec")


def missing(df: DataFrame, text: str, cache: DataFrame, model: str, role: str = "context") -> DataFrame:
    """Rows whose text the cache doesn't hold for that model and role."""
    keyed = df.withColumn("text_digest", X.digest(F.coalesce(F.col(text), F.lit(""))))
    return keyed.join(cache.where((F.col("model") == model) & (F.col("role") == role)).select("text_digest"), "text_digest", "left_anti")


def embed_cached(df: DataFrame, text: str, cache, encoder: Encoder = Encoder(), role: str = "context") -> tuple[DataFrame, int]:
    """(text_digest, vec) of the distinct texts of a column, and how many of them had to be embedded: the others, and from
    now on all, are in the cache, a ``store.embedding_cache``."""
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("_t")).distinct()
    keyed = texts.select("_t", X.digest("_t").alias("text_digest"), F.lit(encoder.model).alias("model"), F.lit(role).alias("role"), F.lit(encoder.dim).alias("dim"))
    made = embed(cache.misses(keyed), "_t", encoder.model, encoder.embedder, role, encoder.batch, encoder.window)
    wrong = F.raise_error(F.concat(F.lit(f"{encoder.model} gave vectors of another length than {encoder.dim}: "), F.col("dim").cast("string"))).cast("int")
    n = cache.add(made.withColumn("dim", F.when(F.col("dim") == encoder.dim, F.col("dim")).otherwise(wrong)))
    return keyed.join(cache.get(keyed), ["text_digest", "model", "role", "dim"]).select("text_digest", "vec"), n


def memory_texts(memory: DataFrame) -> DataFrame:
    text = X.search_text("text_normalized", "text", "speaker", "blip_caption", "query")
    return memory.select("sample_id", "memory_id", "dia_id", F.when(text == "", F.col("dia_id")).otherwise(text).alias("text"))


def cosine(questions: DataFrame, vectors: DataFrame, restricted: DataFrame | None = None) -> DataFrame:
    """(sample_id, qa, memory_id, s): clipped cosine of each question and each memory of its sample,
    or of the (sample_id, qa, memory_id) of ``restricted`` only (none of those: no rows).
    ``questions``: sample_id, qa, qvec; ``vectors``: sample_id, memory_id, vec."""
    if restricted is None:
        every = nearest.joined(questions, vectors.select("sample_id", F.col("memory_id").alias("id"), "vec"), True)
        return every.select("sample_id", "qa", F.col("id").alias("memory_id"), "s")
    q = questions.select("sample_id", "qa", M.unit(F.col("qvec")).alias("_q"))
    v = vectors.select("sample_id", "memory_id", M.unit(F.col("vec")).alias("_v"))
    pairs = restricted.select("sample_id", "qa", "memory_id").join(q, ["sample_id", "qa"]).join(v, ["sample_id", "memory_id"])
    return pairs.select("sample_id", "qa", "memory_id", F.round(M.clipped(M.dot(F.col("_q"), F.col("_v"))), 9).alias("s"))


def top(scores: DataFrame, k: int, score: str = "s", tie: str = "memory_id") -> DataFrame:
    """The k best of each question, ties by id as text, ranked from 1; none for a negative k."""
    ranked = scores.withColumn("rank", F.row_number().over(W.partitionBy("sample_id", "qa").orderBy(F.desc(score), tie)))
    return ranked.where(F.col("rank") <= max(k, 0))


def index_matches(index: DataFrame, memory: DataFrame, model: str) -> DataFrame:
    """(sample_id, matches): whether a stored index fits the memories: same model, ids and text digests."""
    have = index.select("sample_id", "memory_id", F.col("text_digest").alias("d1"), F.col("model").alias("m1"))
    want = memory_texts(memory).select("sample_id", "memory_id", X.digest("text").alias("d2"))
    both = want.join(have, ["sample_id", "memory_id"], "full_outer")
    fits = F.col("d1").eqNullSafe(F.col("d2")) & F.col("m1").eqNullSafe(F.lit(model))
    return both.groupBy("sample_id").agg(F.bool_and(fits).alias("matches"))
