"""Operators on small literal histories; operator IDs are named in each test."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from spanledger.functions import text as tx
from spanledger.operators import archive, evaluate, extract, redact, report, resolve, select, verify
from spanledger.plans.compile import compile_histories
from spanledger.sources import records as source
from spanledger.streaming import ingest

RECORD = "history_id string, source_id string, sequence long, role string, content string, trusted boolean, untrusted boolean"


def records(spark, *rows, history="h"):
    return spark.createDataFrame([(history, f"s{i}", i, role, content, False, False) for i, (role, content) in enumerate(rows)], RECORD)


def found(df):
    return [(x.sequence, x.kind, x.text) for x in sorted(df.collect(), key=lambda x: (x.sequence, x.provenance[0].start, x.kind))]


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        ("user", "goal: fix the login\nconstraint: the port must be 8080; never touch src/app/main.py and do not rename keys. Keep it\nFacts:\n- tests pass on main\n* 2) the cache is verified\nfoo\n- not in section"),
        ("tool", "constraint: must not\nsrc/a/b.py:12 ValueError: bad thing\nexit code 3"),
        ("user", "Actually, the port must be 9090 instead; could it be 7000?\r\nTried restarting but it failed; the db must stay\nPlease check whether it works\n  Decided to use x  "),
        ("assistant", "We will modify C:\\Program Files\\x.txt now.\nsee tests/test_x.py::test_a and a/b.py#L10-L12 😀"),
    ]
    df = records(spark, *rows)
    return rows, extract.extract(df)


def test_extraction_G1_to_G13(items):
    rows, got = items
    assert found(got) == [
        (0, "goal", "fix the login"),
        (0, "constraint", "the port must be 8080"),
        (0, "constraint", "never touch src/app/main.py"),
        (0, "constraint", "do not rename keys."),
        (0, "constraint", "Keep it"),
        (0, "confirmed_fact", "tests pass on main"),
        (0, "confirmed_fact", "the cache is verified"),
        (1, "exact_reference", "src/a/b.py:12"),
        (1, "exact_error", "ValueError: bad thing"),
        (1, "exact_error", "exit code 3"),
        (2, "constraint", "Actually, the port must be 9090 instead; could it be 7000?"),
        (2, "user_correction", "Actually, the port must be 9090 instead; could it be 7000?"),
        (2, "unresolved", "could it be 7000?"),
        (2, "discarded_attempt", "Tried restarting but it failed"),
        (2, "constraint", "the db must stay"),
        (2, "goal", "Please check whether it works"),
        (2, "decision", "Decided to use x"),
        (3, "decision", "We will modify C:\\Program Files\\x.txt now."),
        (3, "exact_reference", "C:\\Program Files\\x.txt"),
        (3, "exact_reference", "tests/test_x.py::test_a"),
        (3, "exact_reference", "a/b.py#L10-L12"),
    ]
    for x in got.collect():
        span = x.provenance[0]
        assert rows[x.sequence][1][span.start : span.end] == x.text == span.quote


def test_lines_and_matches_G1_G9(spark):
    text = "a\r\nb\x0bc\x1cd e\rf\n\ng😀"
    got = spark.createDataFrame([(text,)], "t string").select(tx.line_array(F.col("t")).alias("l"), tx.matches(F.col("t"), "[a-g]").alias("m")).first()
    assert got.l == text.splitlines(keepends=True)
    assert [(m.start, m.text) for m in got.m] == [(m.start(), m[0]) for m in re.finditer("[a-g]", text)]


def test_domain_labels_G14(spark):
    df = records(spark, ("user", "Guard rail: keep a and b\n- second\nother"), ("tool", "guard_rail: no"))
    assert found(extract.extract_labels(df, {"guard rail": "constraint"})) == [(0, "constraint", "keep a and b"), (0, "constraint", "second")]
    with pytest.raises(ValueError):
        extract.extract_labels(df, {"1x": "constraint"})


def test_literal_location_G16(spark):
    df = records(spark, ("user", "one two one"))
    asked = spark.createDataFrame([("h", "s0", "context", t) for t in ("two", "one", "three")] + [("h", "s9", "context", "x")], "history_id string, source_id string, kind string, text string")
    got = {(x.source_id, x.text): (x.start, x.end, x.reason) for x in extract.locate_literals(asked, df).collect()}
    assert got == {("s0", "two"): (4, 7, None), ("s0", "one"): (None, None, "repeated"), ("s0", "three"): (None, None, "missing"), ("s9", "x"): (None, None, "source")}


@pytest.fixture(scope="module")
def compiled(spark):
    one = records(
        spark,
        ("user", "constraint: the retry limit must be exactly 5\nconstraint: the cache must be enabled"),
        ("user", "Is the root cause of the login timeout known?"),
        ("user", "Correction: the retry limit must be exactly 7 instead of exactly 5"),
        ("assistant", "confirmed: the root cause of the login timeout is verified"),
        ("user", "the cache must be disabled"),
        ("user", "decision: use b"),
    )
    other = records(spark, ("user", "the cache must be disabled"), ("user", "the cache must be disabled"), history="g")
    return compile_histories(one.unionByName(other), select.Policy(token_budget=900, minimum_ratio=1.0))


def test_resolution_R1_to_R10(compiled):
    got = {(x.history_id, x.kind, x.text): x for x in compiled.items.collect()}
    old = got["h", "constraint", "the retry limit must be exactly 5"]
    new = got["h", "user_correction", "the retry limit must be exactly 7 instead of exactly 5"]
    assert old.status == "superseded" and new.supersedes == [old.id]
    assert got["h", "constraint", new.text].supersedes == [old.id]
    fact = got["h", "confirmed_fact", "confirmed: the root cause of the login timeout is verified"]
    assert "resolves-protected" in fact.tags and got["h", "unresolved", "Is the root cause of the login timeout known?"].status == "superseded"
    sides = [got["h", "constraint", f"the cache must be {x}"] for x in ("enabled", "disabled")]
    assert [s.status for s in sides] == ["conflicting"] * 2 and sides[0].conflicts_with == [sides[1].id]
    asked = [x for x in got.values() if "detected-conflict" in x.tags]
    assert len(asked) == 1 and set(asked[0].conflicts_with) == {s.id for s in sides}
    merged = got["g", "constraint", "the cache must be disabled"]
    assert merged.status == "active" and len(merged.provenance) == 2


CASES = {
    "chain": ["fact: lane four holds boxes", "correction: lane four holds crates instead of boxes", "correction: lane four holds barrels instead of crates"],
    "own": ["constraint: the queue limit must be 10", "Actually, the queue limit must be 20 instead", "Actually, the queue limit must be 30 instead"],
    "two": ["decision: use red paint for doors", "decision: use blue paint for doors", "correction: use green paint for doors instead"],
    "other": ["decision: use red paint for doors", "correction: something else entirely"],
    "adds": ["decision: use red paint for doors", "correction: also the red paint for doors dries"],
    "double": ["constraint: doors must be red so they shall dry", "correction: doors are blue instead of red"],
    "revoked": ["goal: keep the audit log", "Ignore my earlier audit log requirement"],
    "database": ["fact: the database is Postgres", "correction: the db engine is MySQL"],
    "scopes": ["fact: the staging database is Postgres", "correction: the production database is MySQL"],
    "clash": ["fact: the db is Postgres", "fact: the database is MySQL", "fact: previews enabled", "fact: previews disabled", "fact: lane 4 of hall 12 stays open", "fact: lane 4 of hall 12 is not open"],
    "asked": ["Is the leak in pump seven known?", "fact: the leak in pump seven is confirmed", "fact: the pump seven leak was verified again"],
    "asked twice": ["Is the leak in pump seven known?", "Is the leak of pump seven bad?", "fact: the leak of pump seven is confirmed"],
}


@pytest.fixture(scope="module")
def ledgers(spark):
    rows = [(name, f"s{i}", i, "user", text, False, False) for name, texts in CASES.items() for i, text in enumerate(texts)]
    out = {name: {} for name in CASES}
    for x in resolve.resolve(extract.extract(spark.createDataFrame(rows, RECORD))).collect():
        out[x.history_id][x.kind, x.text] = x
    return out


def test_corrections_in_a_chain_replace_each_other_R5_R6(ledgers):
    got = ledgers["chain"]
    first, second = (x.split(": ")[1] for x in CASES["chain"][1:])
    old, made, now = got["confirmed_fact", "lane four holds boxes"], got["confirmed_fact", first], got["confirmed_fact", second]
    assert [x.status for x in (old, made, now)] == ["superseded", "superseded", "active"]
    assert made.supersedes == got["user_correction", first].supersedes == [old.id]
    assert now.supersedes == got["user_correction", second].supersedes == [made.id]
    assert {"correction-derived", "current-value"} <= set(now.tags) and now.confidence == 0.95 and now.priority == 100
    assert "superseded-by-correction" in old.tags and "superseded-by-correction" in made.tags


def test_corrections_with_an_item_of_their_own_R5(ledgers):
    got = ledgers["own"]
    rows = [got["constraint", x] for x in ("the queue limit must be 10", *CASES["own"][1:])]
    assert [x.status for x in rows] == ["superseded", "superseded", "active"]
    assert [x.supersedes for x in rows] == [[], [rows[0].id], [rows[1].id]] and len(got) == 5


def test_corrections_that_replace_nothing_R3_R4(ledgers):
    assert "ambiguous-supersession" in ledgers["two"]["user_correction", "use green paint for doors instead"].tags
    for name in ("other", "adds"):
        own = ledgers[name]["user_correction", CASES[name][1].split(": ")[1]]
        assert "additive-clarification" in own.tags and own.supersedes == [] and len(ledgers[name]) == 2
    assert {x.status for name in ("two", "double", "scopes") for x in ledgers[name].values()} == {"active"}


def test_revocations_leave_no_replacement_R5(ledgers):
    got = ledgers["revoked"]
    assert got["goal", "keep the audit log"].status == "superseded"
    assert not any("correction-derived" in x.tags and x.status == "active" for x in got.values())


def test_a_database_or_an_antonym_is_enough_R8(ledgers):
    assert ledgers["database"]["confirmed_fact", "the database is Postgres"].status == "superseded"
    assert sum(x.status == "conflicting" for x in ledgers["clash"].values()) == 6


def test_questions_close_once_R7(ledgers):
    got = ledgers["asked"]
    asked = got["unresolved", CASES["asked"][0]]
    closers = [x for x in got.values() if x.supersedes]
    assert asked.status == "superseded" and [x.supersedes for x in closers] == [[asked.id]] and closers[0].sequence == 1
    assert {x.status for x in ledgers["asked twice"].values()} == {"active"}


def test_conflicts_equal_all_pairs_compared_J5(spark):
    r = random.Random(9)
    words = ["valve", "pump", "lane", "seal", "gauge", "door"]
    texts = sorted({f"fact: {' '.join(r.sample(words, r.randint(1, 4)))} {r.choice(['is', 'is not', 'set to 5', 'set to 6', 'exactly 7', 'enabled', 'disabled'])}" for _ in range(60)})
    items = resolve.canonicalize(extract.extract(records(spark, *[("user", t) for t in texts])))
    own = resolve._judged(items.where(F.col("kind").isin(resolve.CONFLICT_KINDS)))
    a, b = own.select(F.col("id").alias("x"), F.col("j").alias("xj")), own.select(F.col("id").alias("y"), F.col("j").alias("yj"))
    every = a.join(b, (F.col("xj.kind") == F.col("yj.kind")) & (F.col("x") < F.col("y"))).where(resolve.contradicts(F.col("xj"), F.col("yj")))
    want = {(p.x, p.y) for p in every.select("x", "y").collect()}
    got = [tuple(sorted((p.left, p.right))) for p in resolve.conflict_pairs(items).collect()]
    assert len(want) > 20 and set(got) == want and len(got) == len(want)


def test_selection_and_rendering_B1_to_B6_K2(compiled):
    chosen = {x.history_id: x for x in compiled.selection.collect()}
    prompts = {x.history_id: x.prompt for x in compiled.prompts(allow_unverified=True).collect()}
    assert set(chosen) == set(prompts) == {"g", "h"}
    for key, x in chosen.items():
        assert len(prompts[key]) == x.prompt_chars and x.prompt_tokens == max(1, -(-x.prompt_chars // 4))
    assert prompts["g"].startswith('<typed_memory schema="1.0" content="untrusted-jsonl">\nconstraint:\n- {"text":"the cache must be disabled"')


def test_verification_passes_and_finds_faults_V(compiled):
    assert {x.code for x in compiled.issues.collect() if x.severity == "error"} == set()
    bent = compiled.items.withColumn("text", F.when(F.col("kind") == "decision", "use c").otherwise(F.col("text")))
    bent = bent.withColumn("roles", F.when(F.col("kind") == "confirmed_fact", F.array(F.lit("tool"))).otherwise(F.col("roles")))
    bent = bent.withColumn("supersedes", F.when(F.col("kind") == "user_correction", F.array(F.lit("m-none"))).otherwise(F.col("supersedes")))
    bent = bent.where("kind <> 'constraint' or status <> 'conflicting'")
    codes = {x.code for x in verify.verify(compiled.records, bent, compiled.selection, compiled.candidates).collect()}
    assert {
        "unsupported_claim_terms", "claim_not_atomic_source_literal", "claim_order_not_supported", "source_role_metadata_mismatch", "invalid_supersession_edge",
        "invalid_protected_resolution", "invalid_internal_conflict", "selected_item_missing", "protected_commitment_missing",
    } <= codes


def test_many_histories_equal_single_ones(spark, compiled):
    alone = compile_histories(compiled.records.where("history_id = 'g'"))
    both = {(x.id, x.status, x.text) for x in compiled.items.where("history_id = 'g'").collect()}
    assert {(x.id, x.status, x.text) for x in alone.items.collect()} == both


def test_redaction_X1_to_X5(spark):
    pem = "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----"
    text = f"é {pem} password: 'hunter22' and api_key=abcdef1 Bearer {'x' * 16} https://u:pw@h ghp_{'a' * 24} 😀"
    df = records(spark, ("user", text), ("user", "nothing"), ("user", None))
    out = redact.redact(df)
    got = [x.content for x in out.orderBy("sequence").collect()]
    assert len(got[0]) == len(text) and got[1:] == ["nothing", None] and "hunter22" not in got[0] and got[0].count("\n") == 2
    for kept in ("password: '", "api_key=", "Bearer ", "https://", "@h", "😀"):
        assert kept in got[0]
    names = [x.detector for x in redact.findings(out).orderBy("start").collect()]
    assert names == ["pem_private_key", "credential_assignment", "credential_assignment", "bearer_token", "url_userinfo", "github_token"]
    assert redact.verify_redaction(df, out).count() == 0 and redact.verify_redaction(df, df).count() == 2


def test_redaction_queries_pass_over_whole_texts(spark, tmp_path):
    import hashlib

    from spanledger.plans import queries

    key, long = "sk-" + "A1b2" * 6, "plain words é 😀 " * 3000
    texts = {0: f"first {key}\nlast", 1: None, 2: long + key + " " + long, 3: "password: hunter22", 6: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    md5 = {i: hashlib.md5(str(i).encode()).hexdigest() for i in texts}
    behind = {0: ("key sk-", md5[0]), 1: ("token ghp_", md5[1]), 2: ("id AKIA", md5[2][:16].upper()), 3: ("password: ", md5[3][:12]), 6: ("key sk-", md5[6])}
    want = {}
    for i, text in texts.items():
        word, secret = behind[i]
        kept = word if i == 3 else word.split(" ")[0] + " "
        hidden = "*" * (len(word) - len(kept) + len(secret))
        own = (text or "").replace(key, "*" * len(key)).replace("hunter22", "*" * 8)
        want[f"d{i}"] = f"{own}\nnote {i} {kept}{hidden} end"
    assert {x.history_id: x.content for x in queries.redact_texts(spark, str(tmp_path)).collect()} == want
    found = {x.detector: tuple(x)[1:] for x in queries.redact_findings(spark, str(tmp_path)).collect()}
    assert found == {"openai_style_key": (4, 3, 35 * 2 + 27 * 2), "github_token": (1, 1, 36), "aws_access_key_id": (1, 1, 20), "credential_assignment": (2, 1, 20)}


def test_archive_A1_A2_A5(spark):
    df = records(spark, *[("user", f"c{i}") for i in range(6)])
    kept = archive.archived(df)
    assert archive.verify(kept).count() == 0
    assert {x.code for x in archive.verify(kept.where("sequence <> 3")).collect()} == {"position", "link"}
    assert archive.append(df.where("sequence < 4"), df).count() == 2 and archive.append(df, df).count() == 0
    heads = archive.chain(df)
    assert archive.verify_heads(kept, heads).count() == 0 and archive.verify_heads(kept.where("sequence < 5"), heads).count() == 1
    with pytest.raises(Exception, match="collision"):
        archive.append(df, df.withColumn("content", F.lit("other"))).collect()


def test_long_histories_are_chained_in_time_A2(spark, tmp_path):
    """Cost follows the number of records: with entries copied at every step 30,000 of them took over a minute each time."""
    import time

    from spanledger.plans import checked

    def plain(n):
        sha, head, entries = lambda text: hashlib.sha256(text.encode()).hexdigest(), "0" * 64, []
        for i in range(n):
            record = sha("".join(f"{len(part)}:{part}" for part in (f"s{i}", str(i), "user", f"é{i}")))
            before, head = head, sha(f"{i}:{head}:{record}")
            entries.append((f"s{i}", i, before, head))
        return head, entries

    sizes = {"a": 1, "b": archive.BLOCK, "c": archive.BLOCK + 1, "d": 30_000}
    made = spark.createDataFrame(list(sizes.items()), "history_id string, n long").select("history_id", F.explode(F.expr("sequence(0L, n - 1)")).alias("sequence"))
    rows = made.select("history_id", F.concat(F.lit("s"), "sequence").alias("source_id"), "sequence", F.lit("user").alias("role"), F.concat(F.lit("é"), "sequence").alias("content")).repartition(4)
    began = time.time()
    want = {h: plain(n) for h, n in sizes.items()}
    assert {x.history_id: (x.head, [tuple(e) for e in x.entries]) for x in archive.chain(rows).collect()} == want
    assert {x.history_id: x.head for x in archive.heads(rows).collect()} == {h: head for h, (head, _) in want.items()}
    part = spark.range(60_000).select(F.col("id").alias("p_partkey"), F.concat(F.lit("part "), "id").alias("p_name"), F.when(F.col("id") % 2 == 0, 3).otherwise(5).alias("p_size"))
    part.write.parquet(str(tmp_path / "part.parquet"))
    got = {tuple(x) for x in checked.manifest_checks(spark, str(tmp_path)).collect()}
    assert got == {(True, True, False, True, False, 1), (True, True, True, True, True, 1)}
    assert time.time() - began < 60


def test_manifest_and_diff_T1_T2_I3(spark, compiled):
    heads = archive.chain(compiled.records)
    made = report.manifest(compiled.records, compiled.items, compiled.summary, heads)
    anchors = made.select("history_id", F.col("manifest_sha256").alias("expected"))
    assert {x.passed for x in report.verify_manifest(made, anchors, compiled.records, compiled.items, heads).collect()} == {True}
    less = compiled.items.where("kind <> 'decision'")
    assert {x.history_id: x.artifact for x in report.verify_manifest(made, anchors, compiled.records, less, heads).collect()} == {"h": False, "g": True}
    changes = report.diff(less, compiled.items).groupBy("change").count().collect()
    assert {x.change: x["count"] for x in changes}["added"] == 1


def test_evaluation_against_brute_force(spark):
    r = random.Random(2)
    spans = [("h", "s", i, a, a + r.randint(1, 400)) for i in range(40) for a in [r.randint(0, 900)]]
    df = spark.createDataFrame(spans, "history_id string, source_id string, id int, start int, end int")
    got = {(x.l_id, x.r_id) for x in evaluate.overlaps(df, df, 64).collect()}
    assert got == {(a[2], b[2]) for a in spans for b in spans if a[3] < b[4] and b[3] < a[4]}
    hist = records(spark, *[("user", "x" * n) for n in (5, 7, 9)])
    joined = "\n".join("x" * n for n in (5, 7, 9))
    for tail in (False, True):
        parts = [x.content for x in evaluate.truncate(hist, 10, tail).orderBy("sequence").collect()]
        assert "\n".join(parts).strip("\n") == (joined[-10:] if tail else joined[:10]).strip("\n")


def test_reading_S1_to_S6(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('\ufeff{"role": "user", "content": "hi", "metadata": {"k": 1}}\n\n{"id": "b", "sequence": 7, "role": "tool", "content": "x", "authority": {"trusted_for_state": false}}\n')
    got = sorted(source.read_json(spark, str(tmp_path / "a.jsonl")).collect(), key=lambda x: x.sequence)
    assert [(x.sequence, x.role, x.untrusted) for x in got] == [(0, "user", False), (7, "tool", True)] and got[1].source_id == "b"
    (tmp_path / "b.json").write_text('{"messages": [{"role": "user", "content": "a"}, {"role": "user", "content": "b"}]}')
    assert [x.content for x in source.read_json(spark, str(tmp_path / "b.json"), lines=False).orderBy("sequence").collect()] == ["a", "b"]
    (tmp_path / "c.jsonl").write_text('{"role": "user", "role": "tool", "content": "a"}')
    with pytest.raises(Exception, match="strict JSON"):
        source.read_json(spark, str(tmp_path / "c.jsonl")).collect()


def test_streaming_ST1_ST2(spark, tmp_path):
    df = records(spark, *[("user", f"c{i}") for i in range(5)])
    df.where("sequence in (0, 4)").write.parquet(str(tmp_path / "in/a"))
    touched = []

    def run():
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in/*"))
        ingest.ingest(stream, str(tmp_path / "t"), str(tmp_path / "c"), lambda rows, n: touched.append(rows.count())).awaitTermination()

    run()
    df.write.parquet(str(tmp_path / "in/b"))
    run()
    assert ingest.stored(spark, str(tmp_path / "t"), df.schema).count() == 5 and touched == [2, 5]


def test_queries_have_names_and_sql():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_model_responses_G15_G17(spark):
    import json

    from spanledger.operators import plugins

    df = records(spark, ("user", "the port must be 80; note"), ("tool", "the port must be 81"), ("assistant", "it may be verified"))
    claim = lambda kind, text, *spans, **more: {"kind": kind, "text": text, "provenance": [dict(zip(("source_id", "start", "end"), s, strict=True)) for s in spans], **more}
    claims = [
        claim("constraint", "the port must be 80", ("s0", 0, 19), confidence=0.5),
        claim("constraint", "the port must be 81", ("s1", 0, 19)),
        claim("constraint", "the port", ("s0", 0, 8)),
        claim("constraint", "other", ("s0", 0, 19)),
        claim("nothing", "x", ("s0", 0, 1)),
        claim("confirmed_fact", "it may be verified", ("s2", 0, 18)),
        claim("context", "note", ("s9", 0, 4)),
        claim("context", "note", ("s0", 21, 25), tags=["current-value"]),
        claim("context", "note"),
    ]
    asked = spark.createDataFrame([("h", json.dumps({"items": claims})), ("g", "no json")], "history_id string, response string")
    items, rejected = plugins.decode(asked, df)
    assert [(x.text, x.confidence) for x in items.collect()] == [("the port must be 80", 0.5)]
    reasons = ["authority", "atom", "literal", "kind", "uncertain", "span", "tag", "span"]
    assert {(x.history_id, x.place): x.reason for x in rejected.collect()} == {("h", k + 1): r for k, r in enumerate(reasons)} | {("g", -1): "response"}
    whole, counts = plugins.composite(model=items, rules=extract.extract(df))
    assert {x.name: x.n_items for x in counts.collect()} == {"model": 1, "rules": whole.count() - 1}


def test_texts_with_any_sign_are_matched_as_they_are_G9(spark):
    texts = ["a\u0001b\u0002a", "\u0002a\u0001", "\u0001\u0001", "x a\u0002\u0003 a\u0001", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.matches(F.col("t"), "a.?").alias("m"), tx.pieces(F.col("t"), "a").alias("p")).collect()
    for x in rows:
        assert [(m.start, m.text) for m in x.m] == [(m.start(), m[0]) for m in re.finditer("a.?", x.t)]
        assert [p.text for p in x.p] == x.t.split("a")


def test_no_text_can_move_between_the_parts_of_a_digest(spark):
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("a", None), ("a", ""), ("1:a", "bc")], "x string, y string")
    assert rows.select(tx.hash_of(F.col("x"), F.col("y"))).distinct().count() == 5


def test_control_characters_stay_apart_W10(spark):
    texts = ["a\u0001", "a\u0002", "a\\u0001", "a\n", "a "]
    shown = [x[0] for x in spark.createDataFrame([(t,) for t in texts], "t string").select(report.visible(F.col("t"))).collect()]
    assert shown == ["a\\u0001", "a\\u0002", "a\\\\u0001", "a\\u000a", "a\\u2028"]


def test_artifacts_are_read_strictly_K1_S9(spark):
    from spanledger.operators import artifact

    rows = records(spark, ("user", "goal: fix the login"))
    items = extract.extract(rows)
    chosen = items.groupBy("history_id").agg(F.collect_list("id").alias("selected"))
    made = artifact.build(items, chosen, items.select("history_id").distinct().withColumn("passed", F.lit(True)), rows)
    assert artifact.issues(artifact.load(made), rows).collect() == []
    assert [x.text for x in artifact.items_of(artifact.load(made)).collect()] == ["fix the login"]
    text = made.first().artifact
    for bent, codes in ((text[:-1], {"invalid_artifact_json"}), (text.replace("fix the login", "fix the logon", 1), {"artifact_digest_mismatch"}), ("null", {"invalid_artifact_json"}), (None, {"invalid_artifact_json"})):
        given = spark.createDataFrame([("h", bent)], "history_id string, artifact string")
        assert {x.code for x in artifact.issues(artifact.load(given), rows).collect()} == codes


# ---- limits, plug-ins, sources, command line ----


def test_histories_beyond_their_limits_are_refused(spark):
    from spanledger.operators import limits

    rows = records(spark, *[("user", f"the door {i} must be closed") for i in range(5)])
    found = extract.extract(rows)
    limits.refuse(found)
    with pytest.raises(ValueError, match="comparisons"):
        limits.refuse(found, limits.Limits(max_comparisons=9))
    with pytest.raises(ValueError, match="items"):
        compile_histories(rows, limits=limits.Limits(max_items=4))
    assert limits.exceeded(found.limit(0)).collect() == []
    left = [x.allowance for x in limits.allowance(found, rows, limits.Limits(max_items=3)).orderBy("sequence").collect()]
    assert left == [3, 2, 1, 0, -1]


def test_a_failing_primary_extractor_degrades_unless_strict_UD1(spark):
    from spanledger.operators import limits

    rows = records(spark, ("user", "goal: fix the login"))
    found = extract.extract(rows)
    broken = lambda r: r.select(F.raise_error(F.lit("no")).alias("history_id"))
    items, failure = limits.primary_or(broken, rows, found)
    assert failure and [x.text for x in items.collect()] == ["fix the login"]
    with pytest.raises(Exception):
        limits.primary_or(broken, rows, found, strict=True)
    assert limits.primary_or(lambda r: found, rows, found.limit(0))[1] is None


def test_token_counters_that_are_not_additive_UD4(spark):
    from spanledger.operators import limits

    rows = records(spark, ("user", "goal: fix the login\nprogress: half done\nprogress: tests are written"))
    found = extract.extract(rows)
    few = limits.select_counted(found, rows, lambda t: len(set(t)), "letters", select.Policy(token_budget=1, minimum_ratio=1.0)).first()
    many = limits.select_counted(found, rows, lambda t: len(set(t)), "letters", select.Policy(token_budget=999, minimum_ratio=0.1)).first()
    assert (len(few.selected), len(many.selected), many.counter_id) == (1, 3, "letters")
    with pytest.raises(Exception, match="gave -1"):
        limits.select_counted(found, rows, lambda t: -1, "bad").collect()


def test_files_of_any_kind_are_detected_and_bounded_S1_S4_S5(spark, tmp_path):
    texts = {
        "a.jsonl": '{"role":"user","content":"one"}\n\n{"role":"user","content":"two"}', "b.json": '{"events":[{"role":"user","content":"three"}]}',
        "c.txt": '{"role":"user","content":"four"}\n{"role":"user","content":"five"}', "d.json": '[{"role":"user","content":"six"}]', "e.json": '{"role":"user","content":"seven"}',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    got = source.read_json(spark, str(tmp_path), lines=None)
    assert sorted(x.content for x in got.collect()) == sorted("one two three four five six seven".split())
    assert got.select("history_id").distinct().count() == 5
    digest = hashlib.sha256(b"x").hexdigest()
    for k, (text, message) in enumerate(
        [("[" * 130 + "]" * 130, "nested too deep"), ('{"role":"user","content":"x","metadata":' + "7" * 700 + "}", "integer too long"), ('{"role":"user","content":"y","content_sha256":"' + digest + '"}', "content_sha256")]
    ):
        (tmp_path / f"bad{k}").mkdir()
        (tmp_path / f"bad{k}" / "x.jsonl").write_text(text)
        for lines in (True, None):
            with pytest.raises(Exception, match=message):
                source.read_json(spark, str(tmp_path / f"bad{k}"), lines=lines).collect()
    (tmp_path / "good.jsonl").write_text('{"role":"user","content":"x","content_sha256":"' + digest + '"}')
    assert source.read_json(spark, str(tmp_path / "good.jsonl")).count() == 1


def test_archives_refuse_an_unexpected_head_and_half_chains_A1_A3(spark):
    held = archive.archived(records(spark, ("user", "one"), ("user", "two")))
    head = held.orderBy(F.desc("position")).select("history_id", F.col("entry").alias("head")).limit(1)
    more = records(spark, ("user", "one"))
    assert archive.append(held, more, head).count() == 0
    with pytest.raises(ValueError, match="unexpected head"):
        archive.append(held, more, head.withColumn("head", F.lit("0")))
    with pytest.raises(Exception, match="chained in part"):
        archive.upgrade(held.withColumns({c: F.when(F.col("position") == 0, F.col(c)) for c in ("previous", "entry", "position")})).collect()


def test_command_line_K6(spark, tmp_path, capsys):
    from spanledger.__main__ import main

    path = lambda n: str(tmp_path / n)
    (tmp_path / "r.jsonl").write_text('{"history_id":"h","role":"user","content":"goal: fix the login\\nconstraint: the door must be closed"}\n')
    assert main(["compile", path("r.jsonl"), path("out"), "--prompts", path("prompts")], spark) == 0
    assert "fix the login" in spark.read.parquet(path("prompts")).first().prompt
    assert main(["compile", path("r.jsonl"), path("out2"), "--require-target"], spark) == 4
    capsys.readouterr()
    assert main(["verify", path("out"), path("r.jsonl")], spark) == 0 and capsys.readouterr().out == ""
    made = spark.read.parquet(path("out"))
    made.withColumn("artifact", F.replace("artifact", F.lit("fix the login"), F.lit("fix the logon"))).write.parquet(path("bent"))
    assert main(["verify", path("bent"), path("r.jsonl")], spark) == 3
    told = capsys.readouterr().out
    assert "artifact_digest_mismatch" in told and "invalid_provenance" in told
    assert main(["inspect", path("out")], spark) == 0 and main(["diff", path("out"), path("bent")], spark) == 0
    assert "modified" in capsys.readouterr().out
    assert main(["archive", path("r.jsonl"), path("kept")], spark) == 0 and main(["head", path("kept")], spark) == 0
    assert main(["redact", path("r.jsonl"), path("masked")], spark) == 0
    (tmp_path / "no.jsonl").write_text("{")
    assert main(["compile", path("no.jsonl"), path("out3")], spark) == 2


def test_records_without_a_sequence_follow_the_last_ST1(spark):
    row = lambda h, i, n, c: (h, i, n, "user", c, False, False)
    held = spark.createDataFrame([row("h", "a", 4, "one"), row("h", "b", 2, "two")], RECORD)
    batch = spark.createDataFrame([row("h", "d", None, "four"), row("h", "c", None, "three"), row("h", "c", None, "three"), row("h", "a", None, "one"), row("h", "e", 7, "late"), row("g", "x", None, "new")], RECORD)
    given = {(x.history_id, x.source_id): x.sequence for x in ingest.numbered(batch, held).collect()}
    assert given == {("h", "a"): 4, ("h", "c"): 8, ("h", "d"): 9, ("h", "e"): 7, ("g", "x"): 0}
    assert sorted(x.source_id for x in archive.append(held, ingest.numbered(batch, held)).collect()) == ["c", "d", "e", "x"]
    changed = spark.createDataFrame([row("h", "a", None, "another")], RECORD)
    with pytest.raises(Exception, match="collision"):
        archive.append(held, ingest.numbered(changed, held)).collect()
    assert ingest.numbered(batch.limit(0), held).collect() == []


# ---- long texts, many matches ----


def test_pieces_and_matches_of_many_cells_equal_plain_ones(spark):
    from spanledger.functions import text as tx

    for text in ("", ";", "a;b", "é; " * 20_000, "x\u0001;" * 700, ";" * 129, "ab; " * 127 + "ab"):
        row = spark.createDataFrame([(text,)], "t string").select(tx.pieces(F.col("t"), ";").alias("p"), tx.matches(F.col("t"), "[^; ]+").alias("m")).first()
        want, at = [], 0
        for piece in text.split(";"):
            want.append((at, piece))
            at += len(piece) + 1
        got = [(x.start - k, x.text) for k, x in enumerate(row.p)]
        assert [(s + k, t) for k, (s, t) in enumerate(got)] == [(s, t) for s, t in want]
        assert [(x.start, x.text) for x in row.m] == [(m.start(), m.group()) for m in re.finditer(r"[^; ]+", text)]


def test_redaction_of_thousands_of_secrets_in_a_text(spark):
    secret = "sk-abcdefghijklmnopqrstuvwx"
    text = f"é key {secret};\n" * 3000
    pem = "-----BEGIN PRIVATE KEY-----\nab\ncd\n-----END PRIVATE KEY-----\n"
    df = spark.createDataFrame([("h", "a", 1, text), ("h", "b", 2, pem * 300), ("h", "c", 3, None), ("h", "d", 4, "")], "history_id string, source_id string, sequence long, content string")
    out = redact.redact(df)
    got = {x.source_id: x for x in out.collect()}
    assert got["a"].content == text.replace(secret, "*" * len(secret)) and len(got["a"].findings) == 3000
    assert got["b"].content == re.sub(r"[^\n]", "*", pem) * 300 and got["c"].content is None and got["d"].content == ""
    rows = redact.findings(out).collect()
    assert len(rows) == 3300 and {(x.masked, x.line_ends) for x in rows} == {(len(secret), 0), (len(pem) - 4, 3)}


def test_lines_and_sections_are_found_without_a_shuffle(spark):
    rows = [("h", "s", 1, "user", "goals:\n- one\n\n- two\r\nplain\n- three\nconstraints: x; y\n- z", False, False)]
    records = spark.createDataFrame(rows, "history_id string, source_id string, sequence long, role string, content string, trusted boolean, untrusted boolean")
    out = extract.sections(records, extract.DEFAULT_LABELS, False)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = [(x.pos, x.line_start, x.line, x.section) for x in out.orderBy("pos").collect()]
    text, at, want = rows[0][4], 0, []
    for k, (line, section) in enumerate(zip(text.splitlines(True), [None, "goal", None, None, None, None, None, "constraint"], strict=True)):
        want.append((k, at, line.rstrip("\r\n"), section))
        at += len(line)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got][1] == "goal" and [x[3] for x in got][5] is None and [x[3] for x in got][7] == "constraint"


def test_repeated_atoms_count_once(spark):
    atoms = "array(" + ",".join(f"named_struct('start', {s}, 'text', '{t}', 'kind', '{k}', 'tags', array(), 'exact', false)" for s, t, k in [(3, "ab", "goal"), (0, "x", "goal"), (3, "cd", "goal"), (3, "ab", "fact"), (0, "y", "goal")]) + ")"
    got = spark.range(1).select(extract._once(F.expr(atoms)).alias("a")).first().a
    assert [(x.start, x.text, x.kind) for x in got] == [(3, "ab", "goal"), (0, "x", "goal"), (3, "ab", "fact")]


def test_only_what_a_step_makes_equal_is_merged_again(spark, monkeypatch):
    texts = [f"progress: shelf {k} is packed" for k in range(30)] + [
        "constraint: the label count must be exactly 5", "Actually, the label count must be exactly 7 instead", "constraint: the label count must be exactly 5",
        "Is the weight of the crate known?", "confirmed: the weight of the crate is verified", "The vent must be enabled", "The vent must be disabled",
        'unresolved: Unresolved source conflict: "The vent must be enabled" versus "The vent must be disabled"',
    ]
    found = extract.extract(records(spark, *[("user", t) for t in texts]))
    merge, seen = resolve.canonicalize, []

    def counted(items):
        seen.append(items.count())
        return merge(items)

    monkeypatch.setattr(resolve, "canonicalize", counted)
    told = resolve.resolve(found)
    assert seen[0] > 36 and sum(seen[1:]) < 8
    plain = lambda df: sorted((tuple(map(str, r)) for r in df.select(*resolve.COLUMNS).collect()))
    assert plain(told) == plain(merge(told)) and told.where("kind = 'unresolved' and array_contains(tags, 'detected-conflict')").count() == 1


def test_texts_of_one_line_or_without_separators_stay_whole(spark):
    texts = ["", "a", "a;b", "a\n", "\n", "a\r\nb", "a\rb", "a\u2028b", "a\x1cb", "\x01", "a\x01b;c", ";", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = rows.select("k", tx.line_array(F.col("t")).alias("l"), tx.pieces(F.col("t"), ";").alias("p")).orderBy("k").collect()
    lines = [[], ["a"], ["a;b"], ["a\n"], ["\n"], ["a\r\n", "b"], ["a\r", "b"], ["a\u2028", "b"], ["a\x1c", "b"], ["\x01"], ["a\x01b;c"], [";"], None]
    assert [r.l for r in got] == lines
    for t, r in zip(texts, got, strict=True):
        at, want = 0, []
        for piece in t.split(";") if t is not None else []:
            want.append((at, piece))
            at += len(piece) + 1
        assert (r.p if t is None else [tuple(x) for x in r.p]) == (None if t is None else want)
