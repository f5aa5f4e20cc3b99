"""Sessions, staged commits and requests in a stream."""

import hashlib
import json
import random
import threading

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanledger.streaming import requests, sessions

RECORDS = "history_id string, source_id string, sequence long, content string"
COUNTS = "history_id string, n long, text string"


class Feed:
    """Deliveries of records into one session table."""

    def __init__(self, spark, root):
        self.spark, self.root, self.n, self.seen = spark, root, 0, []

    def count(self, records, number):
        told = records.groupBy("history_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("content")), "").alias("text"))
        self.seen.append({r.history_id for r in told.collect()})
        return told

    def deliver(self, rows, on_change=None, **more):
        self.n += 1
        self.spark.createDataFrame(rows, RECORDS).coalesce(1).write.parquet(f"{self.root}/in/{self.n}")
        self.run(on_change, **more)

    def run(self, on_change=None, **more):
        stream = self.spark.readStream.schema(RECORDS).option("recursiveFileLookup", True).parquet(f"{self.root}/in")
        sessions.ingest(stream, f"{self.root}/t", f"{self.root}/c", on_change or self.count, **more)

    def held(self):
        return sorted(tuple(r) for r in sessions.stored(self.spark, f"{self.root}/t", StructType.fromDDL(RECORDS)).collect())

    def refused(self):
        return sorted(((r.history_id, r.source_id, r.code) for r in sessions.refused(self.spark, f"{self.root}/t", StructType.fromDDL(RECORDS)).collect()), key=str)

    def results(self):
        return {r.history_id: (r.n, r.text, r.n_compiled) for r in sessions.compiled(self.spark, f"{self.root}/t", StructType.fromDDL(COUNTS)).collect()}


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, str(tmp_path))


def test_sessions_take_all_of_a_delivery_or_none_and_touch_only_its_histories(feed):
    feed.deliver([("h", "b", None, "y"), ("h", "a", 5, "x"), ("g", "a", None, "z"), ("g", "a", None, "z")])
    feed.deliver([("h", "a", 5, "x"), ("h", "a", None, "x"), ("h", "c", 2, "w"), ("g", "a", 3, "z"), ("g", "q", 9, "n")])
    feed.deliver([("h", "d", 5, "v"), ("k", "a", 0, "w"), ("k", "b", 0, "w"), ("m", "a", 4, "m"), ("n", None, 1, "n"), ("n", "a", 2, "n"), (None, "a", 1, "n")])
    assert feed.held() == [("g", "a", 0, "z"), ("h", "a", 5, "x"), ("h", "b", 6, "y"), ("h", "c", 2, "w"), ("m", "a", 4, "m")]
    assert feed.refused() == sorted(
        [("g", "a", "id_collision"), ("g", "q", "id_collision"), ("h", "d", "sequence_collision"), ("k", "a", "sequence_collision"), ("k", "b", "sequence_collision")]
        + [("n", None, "missing_id"), ("n", "a", "missing_id"), (None, "a", "missing_id")], key=str)
    assert feed.results() == {"g": (1, "z", 1), "h": (3, "wxy", 2), "m": (1, "m", 1)}
    assert feed.seen == [{"h", "g"}, {"h"}, {"m"}]


def test_sessions_equal_one_delivery_and_go_on_after_a_failure(feed):
    rows = [(f"h{k % 5}", f"s{k:03}", k if k % 3 else None, str(k)) for k in range(60)]
    feed.deliver(rows[:20])

    def fail(records, number):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        feed.deliver(rows[10:40], fail)
    feed.run()
    feed.deliver(rows[30:])
    assert len(feed.held()) == 60 and not feed.refused()
    assert sorted(x[3] for x in feed.held()) == sorted(x[3] for x in rows)
    for h, (n, text, _) in feed.results().items():
        assert n == 12 and text == "".join(sorted(str(k) for k in range(60) if f"h{k % 5}" == h))
    assert len({(x[0], x[2]) for x in feed.held()}) == 60


def test_a_history_beyond_its_limit_is_refused(feed):
    feed.deliver([("h", str(k), k, "x") for k in range(5)], most=6)
    feed.deliver([("h", str(k), k, "x") for k in range(5, 8)] + [("g", "a", 1, "y")], most=6)
    feed.deliver([("h", str(k), k, "x") for k in range(5, 30)], most=6)
    assert [x[:2] for x in feed.held()] == [("g", "a"), *[("h", str(k)) for k in range(5)]]
    assert len(feed.refused()) == 28 and {x[2] for x in feed.refused()} == {"too_many_records"}


class States:
    """State kept in dictionaries, which counts how often it is asked or changed."""

    def __init__(self):
        self.calls, self.kept = 0, {}

    def _called(self, result=None):
        self.calls += 1
        return result

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        own = States()
        self.kept[name] = own
        return own

    def get(self):
        return self._called(self.kept.get("value"))

    def exists(self):
        return self._called("value" in self.kept)

    def update(self, value):
        self._called(self.kept.__setitem__("value", value))

    def containsKey(self, key):
        return self._called(key in self.kept)

    def getValue(self, key):
        return self._called(self.kept.get(key))

    def updateValue(self, key, value):
        self._called(self.kept.__setitem__(key, value))


def session_of(states, most=100_000):
    own = sessions.Session(most)
    own.init(states)
    return lambda rows: list(own.handleInputRows(("h",), iter([Row(history_id="h", source_id=i, sequence=s, digest=d) for i, s, d in rows]), None))


def test_a_short_history_costs_two_calls_for_state_a_delivery():
    states = States()
    take = session_of(states)
    for at in (0, 10, 20):
        before = states.calls
        assert [r.sequence for r in take([(f"s{k}", k, "d") for k in range(at, at + 10)])] == [*range(at, at + 10)]
        assert states.calls - before == 2 and not states.kept["ids"].calls + states.kept["places"].calls


def test_long_histories_and_short_ones_are_judged_alike():
    rng = random.Random(5)
    for most in (40, 500):
        states, ids, places, last = States(), {}, {}, -1
        take = session_of(states, most)
        for _ in range(120):
            rows = [(f"s{k}", rng.choice([k, k, None]), "d" if rng.random() > 0.01 else "e") for k in (rng.randrange(600) for _ in range(rng.randrange(1, 12)))]
            codes, new, at = set(), {}, {}
            top = last
            for own, place, told in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0], r[2])):
                known = new.get(own) or ids.get(own)
                if known:
                    codes |= {"id_collision"} if known[1] != told or place not in (None, known[0]) else set()
                    continue
                place = top + 1 if place is None else place
                if place in at or place in places:
                    codes.add("sequence_collision")
                    continue
                new[own], at[place], top = (place, told), own, max(top, place)
            codes |= {"too_many_records"} if len(ids) + len(new) > most else set()
            got = take(rows)
            if codes:
                assert {r.code for r in got} == {min(codes, key=sessions.REASONS.index)} and len(got) == len(rows)
            else:
                assert {r.source_id: (r.sequence, r.digest) for r in got} == new and len(got) == len(new)
                ids, places, last = ids | new, places | at, top
        assert len(ids) > (sessions.RECENT if most > sessions.RECENT else most // 2)
        assert most < sessions.RECENT or states.kept["ids"].kept


def test_of_rival_commits_one_is_refused_and_nothing_of_it_is_seen(spark, tmp_path):
    where, ids = str(tmp_path / "v"), spark.range(0).schema
    assert sessions.at_version(spark, where, ids).count() == 0
    parts = [sessions.stage(spark.range(k, k + 1), where) for k in range(8)]
    assert sessions.at_version(spark, where, ids).count() == 0
    told = []

    def write(part):
        try:
            told.append(sessions.commit(spark, where, part, 0))
        except sessions.Conflict:
            told.append(None)

    threads = [threading.Thread(target=write, args=(p,)) for p in parts]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(told, key=str) == [1] + [None] * 7
    assert sessions.version(spark, where) == 1 and sessions.at_version(spark, where, ids).count() == 1
    assert sessions.commit(spark, where, parts[told.index(None)], 1, "head") == 2
    with pytest.raises(ValueError, match="bound to an archive"):
        sessions.commit(spark, where, parts[0], 2)
    with pytest.raises(ValueError, match="another version"):
        sessions.commit(spark, where, parts[0], 2, "head")
    assert sessions.at_version(spark, where, ids, 1).count() == 1 and sessions.at_version(spark, where, ids).count() == 2


def asked(operation, payload, id_="r", **more):
    return json.dumps({"schema": requests.SCHEMA, "request_id": id_, "operation": operation, "payload": payload} | more)


def test_each_request_has_one_response(spark, tmp_path):
    bundle = {"session_id": "s", "source_count": 1, "source_digest": "x", "rendered": "h\ni", "rendered_sha256": hashlib.sha256(b"h\ni").hexdigest()}
    one = {"id": "a", "role": "user", "content": "c"}
    cases = [
        (asked("capabilities", {}), "capabilities", None),
        (asked("ingest_source_events", {"session_id": "s", "events": [one, one | {"id": "b", "sequence": 4}]}), "ingest_source_events", None),
        (asked("ingest_source_events", {"session_id": "s", "events": [one, one | {"id": "d", "content": "e", "sequence": 4}]}), "ingest_source_events", "invalid_value"),
        (asked("ingest_source_events", {"session_id": "s", "events": [one | {"sequence": -1}]}), "ingest_source_events", "invalid_value"),
        (asked("ingest_source_events", {"session_id": "s", "events": [one | {"id": "d"}]}), "ingest_source_events", None),
        (asked("verify_memory", {"session_id": "s", "bundle": bundle}), "verify_memory", None),
        (asked("verify_memory", {"session_id": "t", "bundle": bundle}), "verify_memory", "unknown_session"),
        (asked("render_context", {"bundle": bundle}), "render_context", None),
        (asked("render_context", {"bundle": bundle | {"rendered": "other"}}), "render_context", "integrity_check_failed"),
        (asked("inspect_memory", {"bundle": bundle}), "inspect_memory", None),
        (asked("inspect_memory", {"bundle": []}), "inspect_memory", "invalid_type"),
        (asked("capabilities", {}, id_="x" * 257), "", "invalid_value"),
        (asked("capabilities", {}, more=1), None, "invalid_value"),
        (asked("capabilities", {"k": "😀"}), "capabilities", "invalid_value"),
        (asked("capabilities", {"k": "\ud83d"}), None, "invalid_value"),
        ('{"schema": 1e999}', None, None), ("{} {}", None, "invalid_json"), ("nan", None, "invalid_json"), ("7", None, "invalid_type"),
    ]
    rows = [(k, x[0]) for k, x in enumerate(cases)] + [(900, "  "), (901, None)]
    spark.createDataFrame(rows, "no long, raw string").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("no long, raw string").parquet(str(tmp_path / "in"))
    requests.serve(stream, str(tmp_path / "t"), str(tmp_path / "c"))
    got = {r.no: r for r in requests.responses(spark, str(tmp_path / "t")).collect()}
    assert sorted(got) == list(range(len(cases)))
    for k, (raw, operation, code) in enumerate(cases):
        if operation == "":
            assert got[k].code == code
        elif "1e999" in raw:
            assert not got[k].ok
        else:
            assert (got[k].operation, got[k].code) == (operation, code), raw
        assert got[k].ok == (got[k].code is None) == (got[k].category is None) and (got[k].result is None) != got[k].ok
    result = lambda k: json.loads(got[k].result)
    assert result(1) == {"session_id": "s", "accepted_events": 2, "source_count": 2} and result(4)["source_count"] == 3
    assert result(5) == {"passed": False, "issues": ["source_count_mismatch", "source_digest_mismatch"]}
    assert result(7)["context"] == "h\ni" and result(9)["lines"] == 2


def test_no_requests_and_none_of_a_kind(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x" * 50)], "no long, raw string")
    assert requests.decode(rows, requests.Limits(max_bytes=10)).first().code == "resource_limit_exceeded"
    assert requests.decode(rows.where("no > 1")).collect() == []


def test_json_with_anything_behind_its_value_is_none(spark):
    from spanledger.functions import text as tx

    bad = ["{} {}", "1],[2", '1},{"w":2', '1,"w":2', "1 2", "[1] x", "", "  ", "{", '{"a":1,"a":2}', "nan", "1]", "}", None]
    good = ['{"a": [1, {"b": "] } [ {"}]}', " 7 ", "[]", "null", '"x"', "{}"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(bad + good)], "k long, t string").select("k", tx.strict_json(F.col("t")).isNull().alias("none"))
    assert [r.none for r in rows.orderBy("k").collect()] == [True] * len(bad) + [False] * len(good)
