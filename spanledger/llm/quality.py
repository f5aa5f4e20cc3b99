"""Operator 6: quality scores by Bradley-Terry pairwise ranking.

Every pair of a document marked 1 and one marked 0 is a preference. The chance that i is
preferred to j is the logistic function of f(i) - f(j), f linear in features of the text, so
training minimises the logistic loss on feature differences. All labelled documents outside
the held-out fold take part: they are dealt into groups by a hash of the id, each group is
fitted on its own pairs, and the weights are averaged. The threshold is a quantile of the
training documents' scores: the share marked 0, found exactly over all of them. The reported
score is a logistic function of f, moved so that this quantile scores 0.7.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, field, fits, fold, parts

THRESHOLD = 0.7
#: Training documents of a group, about, and steps of training in each.
GROUP_ROWS = 8192
STEPS = 1500
#: Bins of a pass that looks for the threshold, and how many scores are looked through at last.
CUT_BINS, CUT_ROWS = 1024, 4096
#: Bytes from which a text is taken in parts.
LONG = 1 << 20
BINS = 12
PUNCTUATION = string.punctuation.encode()
_UPPER = np.zeros(256, bool)
_UPPER[list(string.ascii_uppercase.encode())] = True
_LOWER = np.zeros(256, bool)
_LOWER[list(string.ascii_lowercase.encode())] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(string.digits.encode())] = True


def _lines(raw: bytes) -> Iterator[bytes]:
    at = 0
    while at <= len(raw):
        stop = raw.find(b"\n", at)
        stop = len(raw) if stop < 0 else stop
        yield raw[at:stop]
        at = stop + 1


def _repeats(raw: bytes) -> tuple[int, int, int]:
    """Distinct words, how often the most frequent one stands, and distinct runs of three words, ignoring ASCII case.

    Long texts count 64-bit hashes of words instead of the words, which bounds memory by 8 bytes a word.
    """
    if len(raw) <= LONG:
        folded = raw.lower().split()
        seen = Counter(folded)
        return len(seen), max(seen.values(), default=0), len(set(zip(folded, folded[1:], folded[2:], strict=False)))
    words = np.concatenate([np.fromiter(map(hash, part.lower().split()), np.int64) for part in parts(raw, LONG)]).view(np.uint64)
    counts = np.unique(words, return_counts=True)[1]
    runs = words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1]
    runs = (runs ^ (runs >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + words[2:]
    return len(counts), int(counts.max(initial=0)), len(np.unique(runs))


def features(text: str | None) -> np.ndarray:
    """Shape of a text: lengths, kinds of characters, repetition. Zeros where there is nothing to count."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts, lengths, squares = np.zeros(256, np.int64), 0, 0
    n_words = first = shout = odd = 0
    for part in parts(raw, LONG):
        counts += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        words = part.split()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n_words, lengths, squares = n_words + len(words), lengths + int(sizes.sum()), squares + int((sizes * sizes).sum())
        first += sum(1 for w in words if 65 <= w[0] <= 90)
        shout += sum(1 for w in words if len(w) > 1 and w.isupper())
        odd += sum(1 for w in words if not w[-1:].isalnum())
    size, n = max(len(raw), 1), max(n_words, 1)
    distinct, often, twice = _repeats(raw)
    n_lines, seen = 0, set()
    for line in _lines(raw):
        if line.strip():
            n_lines += 1
            seen.add(line if len(raw) <= LONG else hash(line))
    k = max(n_lines, 1)
    upper, lower = counts[_UPPER].sum(), counts[_LOWER].sum()
    own = [
        np.log1p(len(raw)), np.log1p(n_words), lengths / n, np.sqrt(max(squares / n - (lengths / n) ** 2, 0.0)),
        upper / size, lower / size, upper / max(upper + lower, 1),
        counts[_DIGIT].sum() / size, counts[128:].sum() / size, counts[[9, 10, 13, 32]].sum() / size,
        distinct / n, distinct / np.sqrt(n), often / n, twice / max(n_words - 2, 1), len(seen) / k, np.log1p(n_lines), n / k,
        first / n, shout / n, odd / n, counts[[46, 33, 63]].sum() / n,
    ]
    return np.array([*own, *(counts[list(PUNCTUATION)] / n)], np.float32)


def expand(rows: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How far each feature reaches into each of its quantile bins, 0 to 1: a piecewise-linear basis."""
    low, high = edges[:, :-1], edges[:, 1:]
    width = np.maximum(high - low, 1e-9)
    steps = np.clip((rows[:, :, None] - low) / width, 0, 1)
    over = (rows > edges[:, -1]).astype(np.float64)
    return np.concatenate([steps.reshape(len(rows), -1), over], 1)


def descend(x: np.ndarray, label: np.ndarray, seed: int = 0) -> np.ndarray:
    """Weights of the expanded features x that make the pairs' logistic loss small; both classes must be there."""
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    random = np.random.default_rng(seed)
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, STEPS + 1):  # Adam on batches of preference pairs
        difference = x[random.choice(good, 512)] - x[random.choice(bad, 512)]
        loss = 1 / (1 + np.exp(np.clip(difference @ w, -30, 30)))
        slope = -(loss @ difference) / len(difference) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        rate = 0.03 * (1 - step / STEPS) + 1e-4
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def fit(rows: np.ndarray, label: np.ndarray, weight: np.ndarray, seed: int = 0) -> dict:
    """The model from feature rows, labels and weights of one group; constant scores if a class is missing."""
    if len(np.unique(label)) < 2:
        return {"edges": None, "value": float((label == 1).any()) if len(rows) else 0.5}
    edges = np.quantile(rows, np.linspace(0, 1, BINS + 1), axis=0).T.astype(np.float64)
    x = expand(rows, edges)
    w = descend(x, label, seed)
    raw = x @ w
    order = np.argsort(raw, kind="stable")
    reached = np.cumsum(weight[order]) / weight.sum()
    low = weight[label == 0].sum() / weight.sum()
    at = min(np.searchsorted(reached, low), len(order) - 1)
    cut = (raw[order[at]] + raw[order[min(at + 1, len(order) - 1)]]) / 2
    return {"edges": edges, "w": w, "cut": cut, "scale": 4 / max(raw.std(), 1e-9)}


def score(model: dict, texts: list[str | None]) -> np.ndarray:
    if model["edges"] is None:
        return np.full(len(texts), model["value"])
    rows = np.stack([features(t) for t in texts]) if texts else np.zeros((0, len(model["edges"])))
    out = np.empty(len(rows))
    for at in range(0, len(rows), 2048):
        raw = expand(rows[at : at + 2048], model["edges"]) @ model["w"]
        z = model["scale"] * (raw - model["cut"]) + np.log(THRESHOLD / (1 - THRESHOLD))
        out[at : at + 2048] = 1 / (1 + np.exp(np.clip(-z, -500, 500)))
    return out


def labelled(docs: DataFrame, labels: DataFrame, keep: Column) -> DataFrame:
    """(doc_id, label, x) of every labelled document that is kept, x its features; computed once.

    Labels other than 0 and 1 and null ids are ignored; contradicting labels of a document
    count as 1. Of rows that repeat an id one counts, the one with the smallest text hash; a
    null text is empty.
    """
    told = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & keep)
    told = cut(told.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")))

    @F.pandas_udf("array<float>")
    def shaped(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    text = F.coalesce("text", F.lit(""))
    own = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text.alias("text"))
    few = fits(told)
    own = own.join(F.broadcast(told.select("doc_id")), "doc_id", "left_semi") if few else own
    rows = own.select("doc_id", F.struct(F.xxhash64("text").alias("hash"), shaped("text").alias("x")).alias("row"))
    # Features are shuffled, texts are not.
    rows = rows.join(F.broadcast(told) if few else told, "doc_id").groupBy("doc_id", "label").agg(F.min("row").alias("row"))
    return cut(rows.select("doc_id", "label", F.col("row.x").alias("x")))


def _cut_at(raw: DataFrame, place: int) -> float:
    """The score at a place (from 0) of all scores in order, found by counting in ever narrower bins."""
    low, high, before = *raw.agg(F.min("raw"), F.max("raw")).first(), 0
    while high > low:
        own = raw.where(F.col("raw").between(low, high))
        bin_ = F.least(F.lit(CUT_BINS - 1), F.floor((F.col("raw") - low) / (high - low) * CUT_BINS)).alias("bin")
        counts = sorted(own.groupBy(bin_).agg(F.count("*"), F.min("raw"), F.max("raw")).collect())
        for _, n, least, most in counts:
            if before + n > place:
                low, high = least, most
                break
            before += n
        if n <= CUT_ROWS:
            return sorted(r["raw"] for r in raw.where(F.col("raw").between(low, high)).collect())[place - before]
    return low


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> dict:
    """Learn from all labelled documents outside the held-out fold."""
    rows = labelled(docs, labels, fold(folds) != held)
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {"edges": None, "value": float(1 in n) if n else 0.5}
    width = len(features(""))
    shares = [k / BINS for k in range(BINS + 1)]
    edges = np.array(rows.agg(*[F.percentile_approx(F.get("x", F.lit(k)), shares, 10_000).alias(f"q{k}") for k in range(width)]).first(), np.float64)
    # A group must have both classes: each class is dealt out to no more groups than its rows fill.
    groups = max(1, min(round(sum(n.values()) / GROUP_ROWS), min(n.values()) // 64))

    def fitted(own: pd.DataFrame) -> pd.DataFrame:
        x, label = np.stack(own["x"].to_numpy()).astype(np.float32), own["label"].to_numpy()
        order = np.lexsort((label, *x.T))  # the rows' order must not decide
        if len(np.unique(label)) < 2:
            return pd.DataFrame({"n": [], "w": []})
        return pd.DataFrame({"n": [len(x)], "w": [descend(expand(x[order], edges), label[order])]})

    group = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("group")), F.lit(groups)).alias("group")
    told = sorted((r["n"], r["w"]) for r in rows.select("label", "x", group).groupBy("group").applyInPandas(fitted, "n long, w array<double>").collect())
    w = np.average([t[1] for t in told], axis=0, weights=[t[0] for t in told])

    @F.pandas_udf("double")
    def rawly(xs: pd.Series) -> pd.Series:
        # Row by row, since a product's last bits depend on how many rows it takes at once.
        return pd.Series([float(expand(np.asarray(x, np.float32)[None, :], edges)[0] @ w) for x in xs])

    raw = cut(rows.select(rawly("x").alias("raw")))
    last, low = sum(n.values()) - 1, n[0] - 1
    cut_ = (_cut_at(raw, low) + _cut_at(raw, min(low + 1, last))) / 2
    return {"edges": edges, "w": w, "cut": cut_, "scale": 4 / max(raw.agg(F.stddev_pop("raw")).first()[0], 1e-9)}


def learned(model: dict) -> bool:
    """Whether the model rests on any label."""
    return model["edges"] is not None or model["value"] != 0.5


def rate(docs: DataFrame, model: dict) -> DataFrame:
    """Adds score and predicted to docs; null and empty texts are scored as empty.

    Columns of docs with these names are replaced; all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(score(shared.value, texts.tolist()))

    kept = [field(c) for c in docs.columns if c not in ("score", "predicted")]
    rated = docs.select(*kept, scored(F.col("text")).alias("score"))
    return rated.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Every row is answered by its own text, repeated rows and null ids too (a null id counts as
    the empty text for the fold and is never learned from); null texts are empty ones, which
    are scored. Equal texts have equal scores. Without any learned label every score is 0.5,
    with one class only it is that class's label. Other columns of docs and labels are ignored;
    an empty table gives no rows.
    """
    model = train(docs, labels, folds, held)
    return rate(docs.select("doc_id", (fold(folds) == held).alias("held_out"), "text"), model).drop("text")
