"""Operator 1: language identification by multinomial naive Bayes over hashed character n-grams.

A text is lower-cased and every character that is no letter becomes a space; features are the
runs of one to three characters, hashed into a fixed number of columns. Training counts are
summed by Spark; the log-probability matrix, whose size is columns times languages, goes to
the executors as a broadcast. The more languages there are, the fewer columns each has, so
that the matrix stays within a bound. A batch of texts is scored as a sparse matrix in row order: the
feature columns of all texts in one array, gathered from the matrix and summed by text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, fold, unit_hash, unused

BITS = 15
COLUMNS = 1 << BITS
#: Training documents taken for each language, by a hash of the id.
TRAIN_ROWS = 4000
#: Cells of the matrix, and of a batch's table of texts and languages, at most.
CELLS, TABLE = 1 << 24, 1 << 22
#: Characters handled at once, which bounds a worker's memory.
PIECE = 1 << 20

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def codes(text: str) -> np.ndarray:
    """Code points of a lower-cased text, with 32 for what is no letter."""
    found = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(letters()[found], found, np.uint32(32))


def bits_for(languages: int) -> int:
    """log2 of the columns for so many languages: BITS, or as many as CELLS allows, 6 at least."""
    return max(6, min(BITS, (CELLS // max(languages, 1)).bit_length() - 1))


def hashed(points: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """Columns of the n-grams that start at each of the points but the last two; 2**bits if all are spaces."""
    a, b, c = points[:-2], points[1:-1], points[2:]
    one = a * np.uint32(0x9E3779B1)
    two = (one ^ (one >> np.uint32(15))) + b * np.uint32(0x85EBCA77) + np.uint32(0x165667B1)
    three = (two ^ (two >> np.uint32(13))) * np.uint32(0xC2B2AE3D) + c * np.uint32(0x27D4EB2F)
    blank_a, blank_b, blank_c = a == 32, b == 32, c == 32
    out = []
    for value, blank in ((one, blank_a), (two, blank_a & blank_b), (three, blank_a & blank_b & blank_c)):
        value = value ^ (value >> np.uint32(16))
        column = ((value * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - bits)).astype(np.int32)
        column[blank] = 1 << bits
        out.append(column)
    return out


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(points, starts, numbers of texts): whole texts, or parts of one, of about PIECE characters.

    Each part has a space before it and two after it, or the neighbouring characters where a
    long text was cut, so that no n-gram is lost or counted twice.
    """
    pad = np.full(2, 32, np.uint32)
    held: list[np.ndarray] = []
    numbers: list[int] = []
    size = 0

    def flush():
        starts = np.cumsum([0, *map(len, held)])[:-1]
        return np.concatenate(held), starts, np.array(numbers)

    for number, text in enumerate(texts):
        if not text:
            continue
        low = text.lower()
        for at in range(0, len(low) + 1, PIECE):
            behind = min(max(at + PIECE + 1 - len(low), 0), 2)
            part = np.concatenate([pad[: at == 0], codes(low[max(at - 1, 0) : at + PIECE + 1]), pad[:behind]])
            if held and size + len(part) > PIECE:
                yield flush()
                held, numbers, size = [], [], 0
            held.append(part)
            numbers.append(number)
            size += len(part)
    if held:
        yield flush()


def sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the values of each part; the last two points of a part start no n-gram."""
    values = np.append(values, [0, 0]).astype(np.float64)
    ends = np.append(starts[1:], len(values))
    values[ends - 1] = 0
    values[ends - 2] = 0
    return np.add.reduceat(values, starts)


def log_odds(texts: list[str | None], matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the log-probabilities by text and language, and whether a text has a letter."""
    total, lettered = np.zeros((len(texts), len(matrix))), np.zeros(len(texts), bool)
    bits = max(matrix.shape[1] - 1, 1).bit_length() - 1
    for points, starts, numbers in pieces(texts):
        grams = hashed(points, bits)
        has = np.add.reduceat((points != 32).astype(np.int64), starts) > 0
        np.logical_or.at(lettered, numbers, has)
        for k, row in enumerate(matrix):
            np.add.at(total[:, k], numbers, sums(row[grams[0]] + row[grams[1]] + row[grams[2]], starts))
    return total, lettered


def _count(batches: Iterator[pd.DataFrame], bits: int) -> Iterator[pd.DataFrame]:
    columns, counts = 1 << bits, {}
    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            own = counts.setdefault(lang, np.zeros(columns + 1, np.int64))
            for points, starts, _ in pieces(rows["text"].tolist()):
                valid = np.ones(len(points), np.int64)
                ends = np.append(starts[1:], len(points))
                valid[ends - 1] = valid[ends - 2] = 0
                valid = valid[:-2] > 0
                for gram in hashed(points, bits):
                    own += np.bincount(gram[valid], minlength=columns + 1)
    for lang, own in counts.items():
        own[columns] = 0
        at = np.flatnonzero(own)
        yield pd.DataFrame({"lang": lang, "gram": at, "n": own[at]})


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-priors and the matrix of log-probabilities, from rows (text, lang, doc_id).

    Priors come from all rows; n-grams from TRAIN_ROWS rows or so of each language, chosen by a
    hash of the id. Rows with a null language or text teach nothing.
    """
    labelled = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    names = sorted(sizes)
    if not names:
        return [], np.zeros(0), np.zeros((0, COLUMNS + 1), np.float32)
    bits = bits_for(len(names))
    share = labelled.sparkSession.createDataFrame([(k, min(1.0, TRAIN_ROWS / n)) for k, n in sizes.items()], "lang string, share double")
    place = unit_hash(F.col("doc_id"), F.lit("langid"))
    chosen = labelled.join(F.broadcast(share), "lang").where(place < F.col("share"))
    counts = np.zeros((len(names), (1 << bits) + 1), np.float32)
    summed = (
        chosen.select("text", "lang")
        .mapInPandas(lambda batches: _count(batches, bits), "lang string, gram int, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .groupBy("lang", (F.col("gram") % 16).alias("part"))
        .agg(F.collect_list(F.struct("gram", "n")).alias("grams"))
    )
    number = {k: i for i, k in enumerate(names)}
    for row in summed.toLocalIterator():
        own = np.array([(g["gram"], g["n"]) for g in row["grams"]], np.int64)
        counts[number[row["lang"]], own[:, 0]] = own[:, 1]
    matrix = np.zeros_like(counts)
    for k, row in enumerate(counts):
        smooth = row[:-1].astype(np.float64) + 0.05
        matrix[k, :-1] = np.log(smooth / smooth.sum())
    prior = np.array([sizes[k] for k in names], float)
    return names, np.log(prior / prior.sum()), matrix


def predict(docs: DataFrame, names: list[str], prior: np.ndarray, matrix: np.ndarray) -> DataFrame:
    """Adds lang_pred and score (the posterior of the predicted language) to docs.

    A null text, one without a letter and every text where nothing was learned is `und` with
    score 0. Equal posteriors go to the first language in alphabetical order. Columns of docs
    with these names are replaced; all others stay.
    """
    model = docs.sparkSession.sparkContext.broadcast((names, prior, matrix))

    @F.pandas_udf("lang_pred string, score double")
    def scored(texts: pd.Series) -> pd.DataFrame:
        names, prior, matrix = model.value
        if not names:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": 0.0})
        told, step = [], max(1, TABLE // len(names))
        for at in range(0, len(texts), step):
            total, lettered = log_odds(texts.iloc[at : at + step].tolist(), matrix)
            total += prior
            top = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            named = np.where(lettered, np.array(names, object)[total.argmax(1)], "und")
            told.append(pd.DataFrame({"lang_pred": named, "score": np.where(lettered, top, 0.0)}))
        return pd.concat(told, ignore_index=True) if told else pd.DataFrame({"lang_pred": [], "score": []})

    kept, name = [field(c) for c in docs.columns if c not in ("lang_pred", "score")], unused(docs, "found")
    found = F.col(name)
    return docs.select(*[field(c) for c in docs.columns], scored(F.col("text")).alias(name)).select(
        *kept, found["lang_pred"].alias("lang_pred"), found["score"].alias("score")
    )


def identify(docs: DataFrame, folds: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, learned from the other folds.

    Every row is answered by its own text, repeated rows and null ids too (a null id counts as
    the empty text for the fold); null, empty and letterless texts are `und` with score 0, and
    so is every text where no row has a language. Ties go to the first language in alphabetical
    order. Other columns of docs are ignored; an empty table gives no rows.
    """
    part = fold(folds)
    names, prior, matrix = train(docs.where(part != held))
    return predict(docs.select("doc_id", (part == held).alias("held_out"), "text"), names, prior, matrix).drop("text")
