"""Operator 10: toxicity by multiple-instance learning.

A document is a bag of sentences and only the bag is labelled. A sentence's probability is a
logistic function of its hashed words; the document's is their noisy-or, 1 - prod(1 - p).
The gradient of the document's log-likelihood reaches the words through the sentences, so
the trained model also says which sentences offend.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import field, fold, labelled_texts, parts, unused

THRESHOLD = 0.5
BITS = 18
COLUMNS = 1 << BITS
#: Training documents of each class at most, and characters of all of them.
TRAIN_ROWS, TRAIN_CHARS = 3000, 1 << 24
STEPS = 150
#: Lengths of the beginnings of words that are features beside the words.
BEGINNINGS = (4, 5, 6, 7)
#: A word's likelihood ratio from which it may bear weight.
SIGNIFICANT = 30.0
#: Entries of a worker's cache of word columns.
CACHE = 1 << 19
#: Characters of the chunks in it.
HELD = 1 << 25
#: Chunks scored at once, about, and characters from which a text is taken in parts.
PIECE, LONG = 1 << 18, 1 << 20
#: The chunks of a text and its line breaks, as ``numbers`` takes them.
PLACES = re.compile(r"\n|\S+")
WORDS = re.compile(r"[^\W\d_]+")


def column(word: str) -> int:
    """The hashed column of a lower-cased word."""
    h = crc32(word.encode("utf-8", "surrogatepass"))
    return (h ^ (h >> 16)) & (COLUMNS - 1)


def columns_of(word: str) -> tuple[int, ...]:
    """Columns of a word: itself and its beginnings, which families of words share."""
    return (column(word), *(column("^" + word[:k]) for k in BEGINNINGS if len(word) >= k))


class Chunks(dict):
    """chunk -> number; ``of`` gives each new chunk's value, once, until too many are held.

    A chunk is what lies between white space. Beside its value it has a number of words and
    may end a sentence.
    """

    def __init__(self, of):
        super().__init__()
        self.of, self.values, self.words, self.ends, self.age, self.held = of, [], [], [], 0, 0

    def __missing__(self, chunk: str) -> int:
        own = WORDS.findall(chunk)
        self.held += len(chunk)
        number = self[chunk] = len(self.values)
        self.values.append(self.of(own))
        self.words.append(len(own))
        self.ends.append(any(mark in chunk for mark in ".!?"))
        return number

    def numbers(self, text: str | None, renew: bool = True) -> list[int]:
        """The chunks of the lower-cased text; each line break stands as the chunk ".".

        Numbers hold while ``age`` is the same; a full cache is begun anew if ``renew`` allows it.
        """
        if renew and (len(self.values) >= CACHE or self.held >= HELD):
            self.clear()
            self.values, self.words, self.ends, self.age, self.held = [], [], [], self.age + 1, 0
        return [self[chunk] for chunk in (text or "").lower().replace("\n", " . ").split()]


def columns_in(text: str | None) -> set[int]:
    """The columns of all words of a text."""
    seen: set[str] = set()
    for part in parts(text or "", LONG):
        seen.update(WORDS.findall(part.lower()))
    return {c for word in seen for c in columns_of(word)}


def bag(text: str | None, chunks: Chunks) -> tuple[list[int], list[int], int]:
    """What ``chunks`` gives for all words, repeats included, where each sentence's begin, and how many more sentences have words.

    Only sentences with something to give are listed; wordless sentences are left out.
    """
    found, begins, plain = [], [], 0
    worded = given = False
    for part in parts(text or "", LONG):
        for number in chunks.numbers(part):
            if chunks.words[number]:
                worded = True
                if chunks.values[number]:
                    if not given:
                        begins.append(len(found))
                    given = True
                    found.extend(chunks.values[number])
            if chunks.ends[number]:
                plain += worded and not given
                worded = given = False
    plain += worded and not given
    return found, begins, plain


def ratio(hits: Column, rows: Column, toxic: int, n: int) -> Column:
    """Twice the log-likelihood ratio of a column's document counts against independence of the label.

    hits of rows documents with the column are toxic, as are toxic of all n.
    """
    cells = [(hits, rows, toxic), (rows - hits, rows, n - toxic), (toxic - hits, n - rows, toxic), (n - toxic - rows + hits, n - rows, n - toxic)]
    total = F.lit(0.0)
    for seen, of, own in cells:
        total += F.when(seen > 0, 2 * seen * F.log(seen * float(n) / (of * float(own)))).otherwise(0.0)
    return total


def fit(bags: list[tuple[np.ndarray, np.ndarray, int]], label: np.ndarray, weight: np.ndarray, start: np.ndarray) -> dict:
    """Column weights and bias from (columns, begins, plain sentences) of each document; full batches, Adam.

    ``start`` has the weights to begin with, one for each column that may bear weight. Without
    both labels there is nothing to tell apart: then every document scores the share of the
    one label there is, or 0 without any.
    """
    if not len(bags) or label.min() == label.max():
        return {"constant": float(label.max()) if len(bags) else 0.0}
    n = len(bags)
    words = np.concatenate([np.zeros(0, np.int64), *[b[0] for b in bags]]).astype(np.int32)
    sizes = np.array([len(b[0]) for b in bags], np.int64)
    base = np.cumsum(sizes) - sizes
    begins = np.concatenate([np.zeros(0, np.int64), *[b[1] + o for b, o in zip(bags, base, strict=True)]]).astype(np.int64)
    document = np.repeat(np.arange(n, dtype=np.int32), [len(b[1]) for b in bags])
    sentence = np.repeat(np.arange(len(begins), dtype=np.int32), np.diff(np.append(begins, len(words))))
    plain = np.array([b[2] for b in bags], float)
    w, bias, size = start.astype(float), -5.0, len(start)
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    each = weight / weight.sum()
    for step in range(1, STEPS + 1):
        z = np.bincount(sentence, weights=w[words], minlength=len(begins)) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        rest = 1 / (1 + np.exp(-np.clip(bias, -30, 30)))  # of each plain sentence
        log_clean = np.bincount(document, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n) + plain * np.log1p(-rest)
        clean = np.clip(np.exp(log_clean), 1e-12, 1 - 1e-9)
        # d log(1 - clean) / dz = p clean / (1 - clean); d log(clean) / dz = -p
        pull = np.where(label == 1, clean / (1 - clean), -1.0) * each
        dz = pull[document] * p
        slope = np.empty(size + 1)
        slope[:-1] = -np.bincount(words, weights=dz[sentence], minlength=size) + 1e-4 * w
        slope[-1] = -dz.sum() - (pull * rest * plain).sum()
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w -= move[:-1]
        bias -= move[-1]
    return {"w": w, "bias": float(bias)}


class Judge:
    """Scores texts by a model, with what it knows of chunks kept from text to text."""

    def __init__(self, model: dict):
        self.constant = model.get("constant")
        w = dict(zip(model.get("columns", ()), model.get("w", ()), strict=True))
        self.bias = model.get("bias", 0.0)
        self.chunks = Chunks(lambda words: sum([w.get(c, 0.0) for word in words for c in columns_of(word)]) if words else 0.0)
        self.known, self.age = [np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)], 0

    def _arrays(self) -> list[np.ndarray]:
        """The chunks' values, words and ends as arrays."""
        lists = (self.chunks.values, self.chunks.words, self.chunks.ends)
        if self.age != self.chunks.age:
            self.known, self.age = [x[:0] for x in self.known], self.chunks.age
        n = len(self.known[0])
        if len(lists[0]) > n:
            self.known = [np.concatenate([x, np.array(y[n:], x.dtype)]) for x, y in zip(self.known, lists, strict=True)]
        return self.known

    def batch(self, texts: list[str | None]) -> list[tuple[float, int, int, float]]:
        """For each text the document's probability, and span and probability of its worst sentence.

        The span is given where the document reaches the threshold, else it is -1, -1.
        """
        if self.constant is not None:
            return [(self.constant, -1, -1, 0.0)] * len(texts)
        out, held, n = [], [], 0
        for text in [*texts, ...]:
            long = text is not ... and len(text or "") > LONG
            if text is ... or long or n > PIECE:
                out.extend(self._judged(texts[len(out) : len(out) + len(held)], held))
                held, n = [], 0
            if long:
                out.append(self._long(text))
            elif text is not ...:
                age = self.chunks.age
                held.append(self.chunks.numbers(text))
                n += len(held[-1])
                if self.chunks.age != age:  # it began anew: older numbers no longer hold
                    held = [self.chunks.numbers(t, False) for t in texts[len(out) : len(out) + len(held)]]
        return out

    def _long(self, text: str) -> tuple[float, int, int, float]:
        """As ``batch`` for one text, in parts; the sentence that a part leaves open goes on in the next."""
        clean, best, z, words, at, begin = 0.0, (-1.0, 0, 0), 0.0, 0, 0, 0

        def close(z: np.ndarray, words: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> None:
            nonlocal clean, best
            p = np.minimum(1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30))), 1 - 1e-15)
            p = np.where(words > 0, p, 0.0)
            clean += np.log1p(-p).sum()
            k = int(p.argmax()) if len(p) else 0
            if len(p) and p[k] > best[0]:
                best = (float(p[k]), int(begins[k]), int(stops[k]))

        for part in parts(text, LONG):
            own = np.array(self.chunks.numbers(part), np.int64)
            values, sizes, ends = (x[own] for x in self._arrays())
            number = np.cumsum(ends) - ends  # the sentence of each chunk, counted from the open one
            n = int(ends.sum())
            total = np.bincount(number, weights=values, minlength=n + 1)
            counts = np.bincount(number, weights=sizes, minlength=n + 1)
            total[0] += z
            counts[0] += words
            stops = at + np.flatnonzero(ends) + 1
            begins = np.append(begin, stops)
            close(total[:n], counts[:n], begins[:n], stops)
            z, words, begin, at = float(total[n]), float(counts[n]), int(begins[n]), at + len(own)
        close(np.array([z]), np.array([words]), np.array([begin]), np.array([at]))
        score = float(-np.expm1(clean))
        span = _span(text, best[1], best[2]) if score >= THRESHOLD else (-1, -1)
        return (score, *span, best[0])

    def _judged(self, texts: list[str | None], held: list[list[int]]) -> list[tuple[float, int, int, float]]:
        sizes = np.array([len(x) for x in held], np.int64)
        at = np.concatenate([np.zeros(0, np.int64), *[np.array(x, np.int64) for x in held]])
        values, words, ends = (x[at] for x in self._arrays())
        document = np.repeat(np.arange(len(held)), sizes)
        fresh = np.ones(len(at), bool)
        fresh[1:] = ends[:-1] | (document[1:] != document[:-1])
        sentence = np.cumsum(fresh) - 1
        begins = np.flatnonzero(fresh)
        owner = document[begins]
        z = np.bincount(sentence, weights=values, minlength=len(begins)) + self.bias
        p = np.minimum(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1 - 1e-15)
        p = np.where(np.bincount(sentence, weights=words, minlength=len(begins)) > 0, p, 0.0)
        score = -np.expm1(np.bincount(owner, weights=np.log1p(-p), minlength=len(held)))
        order = np.lexsort((np.arange(len(p)), -p, owner))  # of equal ones the first
        first = np.ones(len(order), bool)
        first[1:] = owner[order][1:] != owner[order][:-1]
        worst = dict(zip(owner[order][first].tolist(), order[first].tolist(), strict=True))
        starts = np.cumsum(sizes) - sizes
        out = []
        for k, text in enumerate(texts):
            if k not in worst:
                out.append((0.0, -1, -1, 0.0))
                continue
            w = worst[k]
            span = (-1, -1)
            if score[k] >= THRESHOLD:
                stop = int(begins[w + 1]) if w + 1 < len(begins) else len(at)
                span = _span(text, int(begins[w] - starts[k]), int(stop - starts[k]))
            out.append((float(score[k]), *span, float(p[w])))
        return out


def _span(text: str, start: int, stop: int) -> tuple[int, int]:
    """Characters from the first to the last of the chunks [start, stop), without line breaks."""
    own = [m.span() for k, m in enumerate(PLACES.finditer(text)) if start <= k < stop and m[0] != "\n"]
    return own[0][0], own[-1][1]


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> dict:
    """Learn from a bounded sample of the labelled documents outside the held-out fold.

    Spark counts the documents of each column and class. Only columns whose documents' labels
    differ beyond chance may bear weight, so only these reach the driver, sentence by sentence.
    """
    rows = labelled_texts(docs, labels, "toxic", fold(folds) != held, TRAIN_ROWS, TRAIN_CHARS)
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n, toxic = sum(sizes.values()), sizes.get(1, 0)
    if not n or toxic in (0, n):
        return fit([()] * n, np.full(n, 1 if toxic else 0), np.ones(n), np.zeros(0))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((2, COLUMNS), np.int64)
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                seen[label, list(columns_in(text))] += 1
        at = np.flatnonzero(seen.any(0))
        yield pd.DataFrame({"word": at, "rows": seen[:, at].sum(0), "hits": seen[1, at]})

    counts = rows.select("text", "label").mapInPandas(counted, "word int, rows long, hits long")
    counts = counts.groupBy("word").agg(F.sum("rows").alias("rows"), F.sum("hits").alias("hits"))
    told = sorted(tuple(r) for r in counts.where(ratio(F.col("hits"), F.col("rows"), toxic, n) > SIGNIFICANT).collect())
    place = {word: k for k, (word, _, _) in enumerate(told)}
    total, hits = (np.array([r[k] for r in told], float) for k in (1, 2))
    share = toxic / n
    odds = np.log((hits + share) / (total - hits + 1 - share)) - np.log(share / (1 - share))
    shared = docs.sparkSession.sparkContext.broadcast(place)

    @F.pandas_udf("words binary, begins binary, plain long")
    def bagged(texts: pd.Series) -> pd.DataFrame:
        known = shared.value
        chunks = Chunks(lambda words: [known[c] for word in words for c in columns_of(word) if c in known])
        out = [bag(t, chunks) for t in texts]
        return pd.DataFrame(
            {"words": [np.array(b[0], "<i4").tobytes() for b in out], "begins": [np.array(b[1], "<i4").tobytes() for b in out], "plain": [b[2] for b in out]}
        )

    found = rows.select("label", "weight", bagged("text").alias("b")).collect()
    found.sort(key=lambda r: (r["label"], r["b"]["words"], r["b"]["begins"], r["b"]["plain"]))  # the rows' order must not decide
    bags = [(np.frombuffer(r["b"]["words"], "<i4"), np.frombuffer(r["b"]["begins"], "<i4"), r["b"]["plain"]) for r in found]
    label, weight = np.array([r["label"] for r in found]), np.array([r["weight"] for r in found])
    return fit(bags, label, weight, np.clip(odds, -4, 4)) | {"columns": [word for word, _, _ in told]}


def rate(docs: DataFrame, model: dict) -> DataFrame:
    """Adds score, predicted and the worst sentence's characters [worst_start, worst_end) and worst_score.

    A text without words has no sentence: score 0 and -1, -1, 0. The span is -1, -1 below the
    threshold. Columns of docs with these names are replaced; all others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    judges: list[Judge] = []  # one in each worker, made at its first batch

    @F.pandas_udf("score double, worst_start int, worst_end int, worst_score double")
    def judged(texts: pd.Series) -> pd.DataFrame:
        if not judges:
            judges.append(Judge(shared.value))
        return pd.DataFrame(judges[0].batch(texts.tolist()), columns=["score", "worst_start", "worst_end", "worst_score"])

    own = ("score", "predicted", "worst_start", "worst_end", "worst_score")
    kept, name = [field(c) for c in docs.columns if c not in own], unused(docs, "judged")
    rated = docs.select(*kept, judged(F.col("text")).alias(name))
    found = F.col(name)
    return rated.select(
        *kept, found["score"].alias("score"), (found["score"] >= THRESHOLD).cast("int").alias("predicted"),
        *[found[c].alias(c) for c in own[2:]],
    )


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted and the worst sentence of every document.

    Every row is answered by its own text, repeated rows and null ids too (a null id counts as
    the empty text for the fold and is never learned from). Null, empty and wordless texts
    score 0. Equal probabilities: the first sentence is the worst. Without any learned label
    every document scores 0, with one class only that class's label. Other columns of docs and
    labels are ignored; an empty table gives no rows.
    """
    model = train(docs, labels, folds, held)
    return rate(docs.select("doc_id", (fold(folds) == held).alias("held_out"), "text"), model).drop("text")
