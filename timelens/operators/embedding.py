"""Filling in embeddings: a default offline embedder and the pending-rows job."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from timelens.functions.columns import embedding_text
from timelens.operators.events import pending_events

# Reads column `text`, adds column `embedding` (array<float>); NULL or an empty
# array for a row it could not embed. A model call is one of these around a
# pandas UDF.
Embedder = Callable[[DataFrame], DataFrame]

DIMENSIONS = 64


def hashing_embedder(dimensions: int = DIMENSIONS) -> Embedder:
    """Word counts hashed into ``dimensions`` places and scaled to length 1.

    A stand-in for a model: it needs no network, and texts with the same
    words are near each other. A word's place is that of the first 32 bits of
    its MD5, which any engine computes; a text without words has no vector.

    Words are counted over the flat word list of an Arrow batch: each different word is
    hashed once, and one count over (text, place) makes all vectors.
    """

    @F.arrow_udf("array<float>")
    def vectors(words: pa.Array) -> pa.Array:
        words = pa.chunked_array([words]).combine_chunks()
        lengths = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        coded = words.flatten().dictionary_encode()
        places = np.array(
            [int(md5(w.encode()).hexdigest()[:8], 16) % dimensions if w else -1 for w in coded.dictionary.to_pylist()], np.int64)
        place = places[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)[place >= 0]
        counts = np.bincount(row * dimensions + place[place >= 0], minlength=len(lengths) * dimensions)
        counts = counts.reshape(-1, dimensions).astype(np.float64)
        length = np.sqrt((counts * counts).sum(axis=1))
        some = length > 0
        unit = (counts[some] / length[some, None]).astype(np.float32)
        ends = np.concatenate([[0], np.cumsum(some)]) * dimensions
        return pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(unit.ravel()), mask=pa.array(~some))

    # A filter on what a function gives would have it called twice, were it not for this mark.
    once = vectors.asNondeterministic()

    def embed(df: DataFrame) -> DataFrame:
        return df.withColumn("embedding", once(F.split(F.lower("text"), r"\s")))

    return embed


def embed_pending(
    events: DataFrame,
    embedder: Embedder,
    embeddings: DataFrame | None = None,
    limit: int | None = None,
) -> DataFrame:
    """New rows ``event_id, embedding`` for the events that have none yet.

    Rows the embedder fails on are not in the result, so they stay pending
    and are tried again by the next run.
    """
    pending = pending_events(events, embeddings, limit)
    texts = pending.select("event_id", embedding_text(F.col("unit"), F.col("message")).alias("text"))
    return (
        embedder(texts)
        .filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0))
        .select("event_id", "embedding")
    )


def with_embeddings(events: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Events with the embedding from the side table, where there is one.

    Of an event embedded more than once the latest load counts, as the side
    table's ``load_id`` tells; without that column the greatest vector.
    """
    last = F.max_by("embedding", "load_id") if "load_id" in embeddings.columns else F.max("embedding")
    side = embeddings.groupBy("event_id").agg(last.alias("_side"))
    if "embedding" not in events.columns:
        return events.join(side.withColumnRenamed("_side", "embedding"), "event_id", "left")
    return (
        events.join(side, "event_id", "left")
        .withColumn("embedding", F.coalesce("_side", "embedding"))
        .drop("_side")
    )


def embed_query(spark: SparkSession, embedder: Embedder, text: str) -> Sequence[float]:
    """The vector of one query text, embedded as it is."""
    row = embedder(spark.range(1).select(F.lit(text).alias("text"))).select("embedding").first()
    if not row or not row.embedding:
        raise ValueError("the query could not be embedded")
    return row.embedding
