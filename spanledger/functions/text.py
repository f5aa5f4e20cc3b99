"""Column functions on texts: lines, matches with offsets, normal forms, tokens.

Offsets are 0-based code points, as Spark counts characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as lx

SPACE = r"[\s\x1C-\x1F]"
#: Stands around matches while a text is cut; for a text that holds it, the first of MARKS that it does not hold.
MARK = "\u0001"
MARKS = [chr(c) for c in range(0xFDD0, 0xFDF0)]


def fresh(rows: DataFrame, name: str) -> str:
    """A column name that rows do not have."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def like(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(pattern), F.lit(False))


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U){SPACE}+\z", "")


def strip(text: Column) -> Column:
    return rstrip(lstrip(text))


def line_array(content: Column) -> Column:
    """Lines with their ends; CR LF is one end. A text of one line is not cut."""
    ends = F.split(content, rf"(?<=[\n\x0B\x0C\x1C-\x1E\x85\u2028\u2029])|(?<=\r)(?!\n)")
    cut = F.filter(ends, lambda x: x != "")
    return F.when(like(content, r"[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]") | (content == "") | content.isNull(), cut).otherwise(F.array(content))


def strip_chars(text: Column, chars: str) -> Column:
    return F.trim(text, F.lit(chars))


def normal(text: Column) -> Column:
    """The form under which equal claims merge: folded, white space collapsed, outer punctuation gone."""
    return strip_chars(strip(F.regexp_replace(F.lower(text), rf"(?U){SPACE}+", " ")), " .;,:-`")


def tokens(text: Column, pattern: str = lx.TOKEN, stop: list[str] = lx.STOPWORDS, shortest: int = 2) -> Column:
    """Folded tokens in order, repeats included, without stop words."""
    raw = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: strip_chars(F.lower(t), "._-"))
    return F.filter(raw, lambda t: (F.length(t) >= shortest) & ~t.isin(stop))


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def support_tokens(text: Column) -> Column:
    """The verifier's tokens."""
    return tokens(text, lx.V_TOKEN, lx.V_STOPWORDS, 1)


def _cells(text: Column, pattern: str) -> Column:
    """What lies between matches and the matches, in turn. A text with every one of MARKS, which are no characters, fails."""
    free = F.get(F.filter(F.array(*[F.lit(m) for m in MARKS]), lambda m: ~F.contains(text, m)), F.lit(0))
    other = F.coalesce(free, F.raise_error(F.lit("a text holds every mark")).cast("string"))
    plain = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    odd = F.split(F.regexp_replace(text, F.lit(pattern), F.concat(other, F.lit("$0"), other)), other)
    return F.when(F.contains(text, F.lit(MARK)), odd).otherwise(plain)


#: Entries that a fold appends to one array before it begins the next.
BLOCK = 128


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def folded(items: Column, state: Column, step: Callable[[Column, Column, Column], tuple[Column, Column]]) -> Column:
    """The whole numbers that a fold gives on its way: step(state, item, its place) is the next state and an array of them.

    Everything that a fold carries is copied at every step, so texts and structs are given by
    their places, and numbers are gathered in blocks: n of them cost n * BLOCK / 2 +
    (n / BLOCK) ** 2 / 2 copies instead of n ** 2 / 2. items is computed once only if bound.
    """
    none = F.array().cast("array<int>")

    def block(outer: Column, k: Column) -> Column:
        def one(inner: Column, i: Column) -> Column:
            after, new = step(inner["state"], F.get(items, i), i)
            return F.struct(after.alias("state"), F.concat(inner["given"], new).alias("given"))

        def close(inner: Column) -> Column:
            return F.struct(inner["state"].alias("state"), F.concat(outer["blocks"], F.array(inner["given"])).alias("blocks"))

        own = F.sequence(k * BLOCK, F.least((k + 1) * BLOCK, F.size(items)) - 1)
        return F.aggregate(own, F.struct(outer["state"].alias("state"), none.alias("given")), one, close)

    last = ((F.size(items) - 1) / BLOCK).cast("int")
    first = F.struct(state.alias("state"), F.array().cast("array<array<int>>").alias("blocks"))
    told = F.aggregate(F.sequence(F.lit(0), last), first, block, lambda outer: F.flatten(outer["blocks"]))
    return F.when(F.size(items) == 0, none).otherwise(told)


def _every_other(cells: Column, first: int) -> Column:
    """array<struct<start, text>> of the cells first, first + 2 ..., each with the length of all before it."""

    def told(all_: Column) -> Column:
        starts = folded(all_, F.lit(0), lambda at, cell, _: (at + F.length(cell), F.array(at)))
        place = F.sequence(F.lit(first), F.size(all_) - 1, F.lit(2))
        found = bound(starts, lambda at: F.transform(place, lambda k: F.struct(F.get(at, k).alias("start"), F.get(all_, k).alias("text"))))
        lone = F.array(F.struct(F.lit(0).alias("start"), F.get(all_, F.lit(0)).alias("text")))
        few = F.when(F.size(all_) == 1, lone) if first == 0 else F.when(F.size(all_) < 2, F.array().cast("array<struct<start:int,text:string>>"))
        return few.otherwise(found)

    return F.when(cells.isNotNull(), bound(cells, told))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, text>> of a pattern's matches from left to right; a text without any is passed over once."""
    return F.when(like(text, pattern), _every_other(_cells(text, pattern), 1)).when(text.isNotNull(), F.array().cast("array<struct<start:int,text:string>>"))


def pieces(text: Column, separator: str) -> Column:
    """array<struct<start, text>> of what lies between a separator's matches; a text without any is passed over once."""
    whole = F.array(F.struct(F.lit(0).alias("start"), text.alias("text")))
    return F.when(text.isNotNull() & ~like(text, separator), whole).otherwise(_cut(text, separator))


def _cut(text: Column, separator: str) -> Column:
    return _every_other(_cells(text, f"(?:{separator})"), 0)


def trimmed(piece: Column) -> Column:
    """A piece without outer white space, its start moved along."""
    left = lstrip(piece["text"])
    return F.struct(
        (piece["start"] + F.length(piece["text"]) - F.length(left)).alias("start"), rstrip(left).alias("text")
    )


def hash_of(*parts: Column) -> Column:
    """SHA-256 of the parts, each behind its length in characters; a null part has the length -1.

    No two different lists of parts are the same text.
    """
    told = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in (p.cast("string") for p in parts)]
    return F.sha2(F.concat(*[F.coalesce(t, F.lit("-1:")) for t in told]).cast("binary"), 256)


_QUOTED = r'"(?:[^"\\]|\\.)*+"'


def json_depth(text: Column) -> Column:
    """How deep arrays and objects are nested in a JSON text; brackets within strings do not count."""
    marks = F.split(F.regexp_replace(F.regexp_replace(text, F.lit(_QUOTED), F.lit("")), r"[^\[\]{}]+", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(s: Column, c: Column) -> Column:
        now = s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    return F.aggregate(marks, start, step, lambda s: s["most"])


def strict_json(text: Column) -> Column:
    """A JSON text as a variant; null if it is none, repeats a key or has anything behind its value.

    The parser stops behind the first value. In brackets and in braces the text must parse as
    well: whatever closes one of them early breaks the other, and more values make a longer array.
    """
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>")
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.when((F.size(listed) == 1) & held.isNotNull(), F.try_parse_json(text))


def has_long_integer(text: Column, digits: int = 640) -> Column:
    """Whether a JSON text holds an integer of more digits, outside of strings."""
    return like(F.regexp_replace(text, F.lit(_QUOTED), F.lit("")), rf"(?<![\d.eE+])\d{{{digits + 1},}}(?![\d.eE])")


def is_utc_time(text: Column) -> Column:
    """Whether a text is an RFC 3339 time in UTC, of a day that there is; such texts of one length sort as times do."""
    shape = like(text, r"\A\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,9})?(Z|\+00:00)\z")
    return shape & F.try_to_timestamp(F.left(text, F.lit(10)), F.lit("yyyy-MM-dd")).isNotNull()


def key_faults(given: Column, required: list[str], optional: tuple[str, ...] = ()) -> Column:
    """Keys of a map that are missing or unknown, as missing:key and unknown:key in order."""
    want, may = (F.array(*[F.lit(k) for k in ks]).cast("array<string>") for ks in (required, [*required, *optional]))
    told = lambda keys, word: F.transform(F.array_sort(keys), lambda k: F.concat(F.lit(f"{word}:"), k))
    return F.concat(told(F.array_except(want, F.map_keys(given)), "missing"), told(F.array_except(F.map_keys(given), may), "unknown"))


def without_keys(given: Column, keys: list[str]) -> Column:
    return F.map_filter(given, lambda k, _: ~k.isin(keys))
