"""Operator 13: near-duplicate vectors by iterative quantisation and multi-index tables.

A bounded sample is centred and turned to its principal axes; iterative quantisation then
learns rotations under which the signs of the coordinates lose least, which spreads variance
evenly over the bits. Codes are the signs of all rotations side by side. The bits are cut into
substrings, one for each Hamming table: vectors whose substrings are equal meet in a bucket.
How many tables there are, and the Hamming radius on whole codes, are set on the sample: every
sampled vector gets a partner at exactly the threshold, and tables are added until ``RECALL``
of these hardest pairs meet; pairs that are closer meet more often.

Every vector is in every table. Within a bucket codes are compared first and only pairs inside
the radius are scored by the cosine of the original vectors in double precision. A pair that
meets in several tables counts in the first one. Pairs never leave a task: each row of a
bucket gives the number of its links, and a spanning forest of the links is kept for the
components. Equal vectors are one vector with a weight. A bucket beyond ``PART`` rows is dealt
into parts and each pair of parts is a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field as dataclass_field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, field, small
from .components import components
from .simhash import forest
from .vectors import finite, matrix, widen

THRESHOLD = 0.9
#: Share of pairs at the threshold that the tables must bring together on the sample.
RECALL = 0.97
#: Cells of the sample the rotations are learned from; vectors for which the bits of a table are chosen; most rows of a part.
CELLS, BUCKET, PART = 1 << 21, 512, 8192
ROUNDS, TABLES, SEED, ROWS_AT_ONCE = 30, 64, 13, 512


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, whatever their size."""
    rows = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def learn_rotation(projected: np.ndarray, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """The rotation that iterative quantisation ends with: signs and the best rotation towards them in turn."""
    rotation, _ = np.linalg.qr(rng.standard_normal((projected.shape[1],) * 2))
    for _ in range(rounds):
        signs = np.where(projected @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(projected.T @ signs, full_matrices=False)
        rotation = left @ right
    return rotation


@dataclass
class Coder:
    """Codes of vectors: the mean, the principal axes, the rotations learned; bits of a table, tables, Hamming radius."""

    mean: np.ndarray
    axes: np.ndarray
    rotations: list[np.ndarray] = dataclass_field(default_factory=list)
    bits: int = 0
    tables: int = 1
    radius: int = 0

    def signs(self, rows: np.ndarray) -> np.ndarray:
        """The bits of unit vectors, as many as the tables use."""
        projected = (widen(rows, len(self.mean)) - self.mean) @ self.axes
        found = [projected @ r >= 0 for r in self.rotations]
        return np.concatenate(found, axis=1)[:, : self.bits * self.tables] if found else np.zeros((len(rows), 0), bool)

    def keys(self, signs: np.ndarray) -> np.ndarray:
        """The substring of every table as a number."""
        cut_up = signs.reshape(len(signs), self.tables, self.bits)
        return cut_up @ (1 << np.arange(self.bits, dtype=np.int64)) if self.bits else np.zeros((len(signs), self.tables), np.int64)


def packed(signs: np.ndarray) -> np.ndarray:
    """Bits in words of 64."""
    raw = np.packbits(signs, axis=1)
    raw = np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8)))
    return np.ascontiguousarray(raw).view(np.uint64)


def partners(rows: np.ndarray, threshold: float, rng: np.random.Generator) -> np.ndarray:
    """For each unit vector another at exactly the threshold, in a direction at random."""
    other = rng.standard_normal(rows.shape)
    other -= (other * rows).sum(1, keepdims=True) * rows
    size = np.linalg.norm(other, axis=1, keepdims=True)
    return threshold * rows + math.sqrt(1 - threshold**2) * np.divide(other, size, out=np.zeros_like(other), where=size > 0)


def fit(sample: np.ndarray, n: int, threshold: float = THRESHOLD, recall: float = RECALL, bucket: int = BUCKET) -> Coder:
    """A coder for n vectors, learned from unit vectors of a sample.

    Tables have about log2(n / bucket) bits, fewer if ``TABLES`` of them would not reach the
    recall; with no bit at all every vector meets every other.
    """
    rng = np.random.default_rng(SEED)
    if not len(sample) or n <= bucket:
        return Coder(np.zeros(sample.shape[1]), np.zeros((sample.shape[1], 0)))
    mean = sample.mean(0)
    _, vectors = np.linalg.eigh(np.cov((sample - mean).T).reshape(sample.shape[1], -1))
    coder = Coder(mean, vectors[:, ::-1][:, :64])
    projected = (sample - mean) @ coder.axes
    own = sample[:2000]
    other = partners(own, threshold, rng)
    for bits in range(math.ceil(math.log2(n / bucket)), 0, -1):
        met, coder.bits = np.zeros(len(own), bool), bits
        for tables in range(1, TABLES + 1):
            while len(coder.rotations) * coder.axes.shape[1] < bits * tables:
                coder.rotations.append(learn_rotation(projected, rng))
            coder.tables = tables
            a, b = coder.signs(own), coder.signs(other)
            met |= (a[:, -bits:] == b[:, -bits:]).all(1)
            if met.mean() >= recall:
                coder.radius = int(np.quantile((a != b).sum(1), 0.999))
                return coder
    coder.bits, coder.tables, coder.radius = 0, 1, 0
    return coder


def links(
    a: np.ndarray, b: np.ndarray, code_a: np.ndarray, code_b: np.ndarray, keys_a: np.ndarray, keys_b: np.ndarray, radius: int, threshold: float
) -> np.ndarray:
    """Which unit vectors of a link with which of b: codes within the radius, no earlier table in common, then the cosine."""
    apart = np.zeros((len(a), len(b)), np.uint16)
    for k in range(code_a.shape[1]):
        apart += np.bitwise_count(code_a[:, k][:, None] ^ code_b[:, k][None, :])
    near = apart <= radius
    for k in range(keys_a.shape[1]):
        near &= keys_a[:, k][:, None] != keys_b[:, k][None, :]
    rows, columns = np.flatnonzero(near.any(1)), np.flatnonzero(near.any(0))
    if len(rows):
        cosine = a[rows] @ b[columns].T
        near[np.ix_(rows, columns)] &= cosine >= threshold
    return near


def _join(coder: Coder, threshold: float):
    """Links within a bucket, or between two of its parts: for each row how many, and a row of a spanning forest."""

    def join(key: tuple, table: pa.Table) -> pa.Table:
        at, first, second = int(key[0]), int(key[2]), int(key[3])
        node, weight, part = (np.asarray(table.column(c)) for c in ("node", "weight", "part"))
        rows = unit(matrix(table.column("vector"), len(coder.mean)))
        signs = coder.signs(rows)
        code, keys = packed(signs), coder.keys(signs)[:, :at]
        left = np.flatnonzero(part == first)
        right = left if first == second else np.flatnonzero(part == second)
        n, labels = np.zeros(len(node), np.int64), np.arange(len(node))
        for low in range(0, len(left), ROWS_AT_ONCE):
            own = left[low : low + ROWS_AT_ONCE]
            other = right[low:] if first == second else right  # within a part each pair is met once
            found = links(rows[own], rows[other], code[own], code[other], keys[own], keys[other], coder.radius, threshold)
            if first == second:
                found[:, : len(own)] &= np.triu(np.ones((len(own),) * 2, bool), 1)
            if not found.any():
                continue
            n[own] += found @ weight[other]
            n[other] += weight[own] @ found
            x, y = np.nonzero(found)
            forest(len(node), labels, own[x], other[y])
        some = np.flatnonzero(n)
        return pa.table({"node": node[some], "n": n[some], "root": node[labels[some]]})

    return join


def table_keys(vector: Column, coder: Coder) -> Column:
    """The bucket of a vector in every table."""

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = matrix(pa.array(batch, pa.list_(pa.float64())), len(coder.mean)) if len(batch) else np.zeros((0, len(coder.mean)))
            yield pd.Series(list(coder.keys(coder.signs(unit(rows)))))

    return keys(vector)


def near_vectors(
    rows: DataFrame, id_: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, bucket: int = BUCKET, part: int = PART
) -> DataFrame:
    """One row for each row: vec_id, n_links, component_id, kept.

    A vector that is null, all zero or holds a null or non-finite component links with
    nothing, nor does a row without an id; these come back with no links, as their own
    component (null without an id), kept. A shorter vector has zeros behind its components.
    Repeated rows are rows of their own and link with each other. component_id is the
    smallest id of all rows reachable; kept says whether it is the row's own id, so rows that
    repeat that id are kept together. An empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    every = rows.select(field(id_).cast("long").alias("vec_id"), field(vector).alias("vector"))
    usable = F.coalesce(F.col("vec_id").isNotNull() & finite("vector") & F.exists("vector", lambda x: x != 0), F.lit(False))
    grouped = every.where(usable).groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    groups = cut(grouped.withColumn("node", F.monotonically_increasing_id()))
    n, width = groups.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
    # The sample: rows by a hash, at most CELLS components of them.
    most = max(CELLS // max(width, 1), 1)
    sample = [r["vector"] for r in groups.select("vector", F.xxhash64("vector").alias("place")).orderBy("place", "vector").limit(most).collect()]
    coder = fit(unit(matrix(pa.array(sample, pa.list_(pa.float64())), width)) if sample else np.zeros((0, width)), n, threshold, bucket=bucket)

    placed = groups.select("node", F.posexplode(table_keys(F.col("vector").cast("array<double>"), coder)).alias("at", "key"))
    placed = cut(placed)
    large = cut(placed.groupBy("at", "key").agg(F.count("*").alias("n")).where(F.col("n") > part))
    large = large.select("at", "key", F.ceil(F.col("n") / part).cast("int").alias("parts"))
    placed = placed.join(small(large), ["at", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = placed.select(
        "node", "at", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with")
    )
    cells = placed.join(groups.select("node", "weight", "vector"), "node").select(
        "at", "key", F.least("part", "with").alias("first"), F.greatest("part", "with").alias("second"), "part", "node", "weight", "vector"
    )
    met = cells.groupBy("at", "key", "first", "second").applyInArrow(_join(coder, threshold), "node long, n long, root long")
    met = cut(met)
    counts = met.groupBy("node").agg(F.sum("n").alias("n"))
    roots = components(met.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    # The smallest id of each component, by its root.
    member = groups.select("node", "rep", "weight", "vector").join(counts, "node", "left").join(roots, "node", "left")
    member = cut(member.withColumn("root", F.coalesce("root", "node")).withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("weight") - 1))
    smallest = member.where("n is not null").groupBy("root").agg(F.min("rep").alias("smallest"))
    known = member.join(smallest, "root", "left").select("vector", "n_links", F.coalesce("smallest", "rep").alias("component_id"))
    found = every.where(usable).join(known, "vector").select("vec_id", "n_links", "component_id")
    alone = every.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


#: The query's rows by brute force.
ORACLE = """
WITH RECURSIVE valid AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
linked AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.9
),
reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT r.a, l.b FROM reached r JOIN linked l ON l.a = r.b
)
SELECT e.vec_id, (SELECT count(*) FROM linked l WHERE l.a = e.vec_id) AS n_links,
    min(r.b) AS component_id, e.vec_id = min(r.b) AS kept
FROM embeddings e JOIN reached r ON r.a = e.vec_id
GROUP BY e.vec_id
"""
