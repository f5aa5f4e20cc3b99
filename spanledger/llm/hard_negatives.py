"""Operator 12: hard negatives by a full sort of each anchor's scores.

Anchors meet all rows in blocks. Anchors are taken in waves whose vectors have at most
``WAVE`` bytes, so what is broadcast is bounded whatever their number; rows stay where they
are and are read batch by batch. Scores are exact integers. In each batch an anchor's scores
are sorted by score and id; the upper limit of each of its positives is found by binary
search, and from there on the entries of other labels are read down to the lower limit. The
first k of all batches are among the first k of each, so a task keeps k entries for each
anchor and positive and one row each leaves it; no score matrix is ever shuffled.

A wave passes over the rows twice: once for the anchors' positives, once for the negatives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, field
from .vectors import finite, matrix, widen

#: Bytes of vectors in a wave of anchors, and anchors scored at once.
WAVE, AT_ONCE = 1 << 22, 256
SCALE = 256


def exact_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of whole numbers held as doubles; an error if they need over 56 bits."""
    width = max(anchors.shape[1], rows.shape[1])
    anchors, rows = widen(anchors, width), widen(rows, width)
    bound = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(width, 1)
    if bound < 2.0**53:
        return (anchors @ rows.T).astype(np.int64)  # every partial sum is a whole number that doubles hold
    if bound < 2.0**56:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    raise ValueError(f"scores of up to {bound:.3g} do not fit; scale the vectors down")


class Kept:
    """The first ``most`` entries by falling score, then rising id, of all that were offered."""

    __slots__ = ("ids", "most", "scores")

    def __init__(self, most: int):
        self.most, self.scores, self.ids = most, np.empty(0, np.int64), np.empty(0, np.int64)

    def offer(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(ids) or len(self.ids) == self.most and (scores[0], -ids[0]) < (self.scores[-1], -self.ids[-1]):
            return
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.most]
        self.scores, self.ids = scores[first], ids[first]


def limits(score: int, lower: int, upper: int) -> tuple[int, int]:
    """The lowest and highest score s with lower * score <= 100 * s <= upper * score."""
    return -((-lower * score) // 100), upper * score // 100


def _batches(batches: Iterator[pa.RecordBatch], anchors: np.ndarray):
    """Ids, labels and, for AT_ONCE anchors at a time, their number and the scores of a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, labels = (np.asarray(batch.column(c)) for c in ("id", "label"))
        rows = np.floor(SCALE * matrix(batch.column("vector")))
        for at in range(0, len(anchors), AT_ONCE):
            yield ids, labels, at, exact_scores(anchors[at : at + AT_ONCE], rows)


def _find_positives(anchors: np.ndarray, own: np.ndarray, kinds: np.ndarray, most: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [Kept(most) for _ in own]
        for ids, labels, at, scores in _batches(batches, anchors):
            for k, row in enumerate(scores, at):
                same = np.flatnonzero((labels == kinds[k]) & (ids != own[k]))
                first = same[np.lexsort((ids[same], -row[same]))[:most]]
                kept[k].offer(row[first], ids[first])
        yield pa.RecordBatch.from_pydict(
            {
                "anchor": np.repeat(np.arange(len(own)), [len(x.ids) for x in kept]),
                "score": np.concatenate([x.scores for x in kept]),
                "id": np.concatenate([x.ids for x in kept]),
            }
        )

    return find


def _find_negatives(anchors: np.ndarray, kinds: np.ndarray, positives: dict[int, list[tuple[int, int]]], k_most: int, lower: int, upper: int):
    """positives: of each anchor, by its number, the (positive's number, score)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {(a, p): Kept(k_most) for a, found in positives.items() for p, _ in found}
        for ids, labels, at, scores in _batches(batches, anchors):
            for a, row in enumerate(scores, at):
                if a not in positives:
                    continue
                order = np.lexsort((ids, -row))
                order = order[labels[order] != kinds[a]]
                falling = -row[order]
                for p, score in positives[a]:
                    low, high = limits(score, lower, upper)
                    first = int(np.searchsorted(falling, -high))
                    taken = order[first : first + k_most]
                    taken = taken[row[taken] >= low]
                    kept[a, p].offer(row[taken], ids[taken])
        full = [(k, x) for k, x in kept.items() if len(x.ids)]
        if full:
            n = [len(x.ids) for _, x in full]
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": np.repeat([k[0] for k, _ in full], n),
                    "positive": np.repeat([k[1] for k, _ in full], n),
                    "score": np.concatenate([x.scores for _, x in full]),
                    "id": np.concatenate([x.ids for _, x in full]),
                }
            )

    return find


def _first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The first of all tasks' entries, each with its rank."""
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame,
    anchor: Column,
    id_: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    k: int = 10,
    positives: int = 5,
    lower: int = 30,
    upper: int = 90,
    wave: int = WAVE,
) -> DataFrame:
    """For each anchor and each of its positives, up to k rows of other labels that score between
    ``lower`` and ``upper`` per cent of the positive: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    anchor: a condition on rows. A component x counts as floor(256 x); a shorter vector has
    zeros behind its components. Rows without id or label, or with a vector that is null or
    holds a null or non-finite component, take no part. Equal scores are ordered by id. Rows
    that repeat an id are rows of their own, but never each other's positives. An anchor
    without positives, or a positive without rows between its limits, gives no row; so does
    an empty table. Other columns are ignored, whatever their names. Scores that need over 56
    bits are refused with an error.
    """
    own = rows.select(
        field(id_).cast("long").alias("id"),
        field(label).cast("long").alias("label"),
        field(vector).cast("array<double>").alias("vector"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"),
    )
    own = own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & finite("vector"))
    table = own.select("id", "label", "vector")
    spark, done = rows.sparkSession, []

    def mine(chosen: list) -> DataFrame:
        ids, kinds = np.array([r["id"] for r in chosen]), np.array([r["label"] for r in chosen])
        vectors = np.floor(SCALE * matrix(pa.array([r["vector"] for r in chosen], pa.list_(pa.float64()))))
        found = table.mapInArrow(_find_positives(vectors, ids, kinds, positives), "anchor long, score long, id long")
        # At most ``positives`` rows for each anchor of the wave.
        best = sorted((r["anchor"], r["rank"], r["score"], r["id"]) for r in _first(found, ["anchor"], positives).collect())
        by_anchor: dict[int, list[tuple[int, int]]] = {}
        for a, p, score, _ in best:
            by_anchor.setdefault(a, []).append((p, score))
        found = table.mapInArrow(
            _find_negatives(vectors, kinds, by_anchor, k, lower, upper), "anchor long, positive long, score long, id long"
        )
        told = spark.createDataFrame(
            [(a, p, int(ids[a]), i, s) for a, p, s, i in best],
            "anchor long, positive long, anchor_id long, positive_id long, positive_score long",
        )
        return (
            _first(found, ["anchor", "positive"], k)
            .join(F.broadcast(told), ["anchor", "positive"])
            .select(
                "anchor_id",
                "positive_id",
                F.col("rank").cast("int").alias("rank"),
                F.col("id").alias("negative_id"),
                "positive_score",
                F.col("score").alias("negative_score"),
            )
        )

    chosen, size = [], 0
    for row in own.where("anchor").select("id", "label", "vector").sort("id", "label", "vector").toLocalIterator():
        chosen.append(row)
        size += 8 * len(row["vector"]) + 64
        if size >= wave:
            done.append(cut(mine(chosen)))
            chosen, size = [], 0
    if chosen or not done:
        done.append(mine(chosen) if chosen else _none(spark))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result


def _none(spark) -> DataFrame:
    return spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )


#: The query's rows by brute force.
ORACLE = """
WITH raw AS (
    SELECT vec_id,
        CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same,
        CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
    FROM raw a CROSS JOIN raw r
    WHERE a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
),
ranked AS (
    SELECT p.anchor_id, p.positive_id, s.id AS negative_id, p.positive_score, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    WHERE 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 10
"""
