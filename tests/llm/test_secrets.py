from __future__ import annotations

import hashlib
import random
import re

from fixtures import empty, frame, sentence, texts

from cladeflow.llm.secrets import REDACTED, redact, scan, secret_report

KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute(text):
    text = text or ""
    spans = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        spans += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    counts = [sum(s[2] == k[0] for s in spans) for k in KINDS]
    joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(spans))
    return (*counts, hashlib.sha256(joined.encode()).hexdigest()), joined


def rows():
    r = random.Random(11)
    out = texts(11)
    values = [
        'password = "hunter2hunter2"', "API_KEY:abc", "apikey= 'abcdef'", "token:::abcdef", "AKIA" + "A1" * 8, "AKIAAKIA" + "B2" * 10,
        "AKIA123", "0123456789abcdef0123456789abcdef", "0123456789abcdef01234567", "0123456789abcdef0123456", "SECRET=deadbeefdeadbeefdeadbeef",
        "ghp_" + "aB3" * 12, "https://user:longpassword@host/x", "Ab1" * 9, "secrettoken=x1y2z3w4", "paſsword=abcdefgh", "toKen=abcdefgh",
    ]
    for i in range(60):
        inside = [r.choice(values) for _ in range(r.randrange(1, 5))]
        out.append((1000 + i, r.choice(["😀 ", "", "é\n"]).join([sentence(r, 3), *inside, sentence(r, 2)])))
    out.append((2000, 'password="' + "z" * 40_000 + '"'))
    return out


def test_base_spans_equal_brute_force(spark):
    given = rows()
    names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    got = sorted((tuple(r) for r in secret_report(frame(spark, given)).select(*names).collect()), key=repr)
    assert got == sorted(((d, *brute(t)[0]) for d, t in given), key=repr)


def test_base_spans_are_among_all(spark):
    given = dict(rows())
    for r in secret_report(frame(spark, list(given.items()))).collect():
        base = set(filter(None, brute(given[r["doc_id"]])[1].split(",")))
        assert base <= set(r["spans"].split(","))


def test_ownership_tells_examples_from_live_values(spark):
    copied, live = "sk-" + "exampleexample00", "sk-" + "onlyhereonlyhere"
    given = [(i, f"key {copied} end", "en", f"owner{i}/r", 0, *[None] * 5, "x", None) for i in range(6)]
    given += [(10 + i, f"key {live} end", "en", f"owner1/r{i}", 0, *[None] * 5, "x", None) for i in range(6)]
    from fixtures import DOCS

    got = {r["doc_id"]: r["spans"] for r in secret_report(spark.createDataFrame([g[:12] for g in given], DOCS)).collect()}
    assert all(got[i] == "" for i in range(6))
    assert all(got[10 + i] == "live:4:23" for i in range(6))


def test_redact_takes_all_spans_out(spark):
    given = rows()
    docs = frame(spark, given)
    out = redact(docs)
    assert out.columns == docs.columns
    by_id = {r["doc_id"]: r for r in scan(docs).collect()}
    for r in out.collect():
        if r["doc_id"] == 200:  # this id is repeated
            continue
        text, at, want = dict(given)[r["doc_id"]], 0, ""
        for s, e in sorted((x["s"], x["e"]) for x in by_id[r["doc_id"]]["secret_scan"]["all"]):
            if s >= at:
                want += text[at:s] + REDACTED
            at = max(at, e)
        assert r["text"] == (want + text[at:] if at else text)


def test_redact_keeps_columns_of_the_names_it_uses(spark):
    given = [(i, f"password = hunter2hunter{i} end", f"mine{i}", [i], i) for i in range(4)] + [(9, None, None, None, None)]
    docs = spark.createDataFrame(given, "doc_id long, text string, secret_scan string, secret_spans array<int>, `a b.c` int")
    docs = docs.selectExpr("*", "'x/y' as source", "'d' as doc")
    out = redact(docs)
    assert out.dtypes == docs.dtypes
    for r in out.collect():
        i = r["doc_id"]
        if i == 9:
            assert r["text"] is r["secret_scan"] is r["secret_spans"] is None
            continue
        assert r["text"] == f"{REDACTED} end"
        assert (r["secret_scan"], r["secret_spans"], r["a b.c"], r["source"], r["doc"]) == (f"mine{i}", [i], i, "x/y", "d")
        assert "hunter" not in str(r)


def test_a_value_that_most_rows_hold(spark):
    """One example in most rows goes another way through the join than rare values do."""
    from fixtures import DOCS

    same = [(i, "key sk-exampleexample00 end", "en", f"o{i % 7}/r", 0, *[None] * 5, "x", None) for i in range(400)]
    rare = [(1000 + i, f"key sk-rare{i:03d}rarerarerare end", "en", f"o{i}/r", 0, *[None] * 5, "x", None) for i in range(20)]
    got = {r["doc_id"]: r for r in secret_report(spark.createDataFrame([g[:12] for g in same + rare], DOCS)).collect()}
    assert len(got) == 420 and all(got[i]["spans"] == "" for i in range(400))
    assert all(got[1000 + i]["n_live"] == 1 for i in range(20))


def test_empty_table(spark):
    assert secret_report(empty(spark)).count() == 0
    assert redact(empty(spark)).count() == 0


def pem(body, kind="RSA "):
    return f"-----BEGIN {kind}PRIVATE KEY-----\n{body}\n-----END {kind}PRIVATE KEY-----"


def test_private_keys_are_whole_and_told_apart_by_their_bodies(spark):
    from fixtures import DOCS

    r = random.Random(5)
    body = lambda: "\n".join("".join(r.choice("aB3+/xY9") for _ in range(64)) for _ in range(12)) + "=="
    shared = pem(body())
    keys = [pem(body()) for _ in range(6)]
    encrypted = pem("Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n" + body())
    texts_ = [f"key {k} end" for k in keys]  # one owner each, all with one header
    texts_ += [f"key {shared} end"] * 5
    texts_ += [f"key {encrypted} end", f'secret = "{pem(body(), "")}" end', f"cut {pem(body())[:500]}"]
    given = [(i, t, "en", f"owner{i}/r", 0, *[None] * 5, "x", None)[:12] for i, t in enumerate(texts_)]
    docs = spark.createDataFrame(given, DOCS)
    got = {x["doc_id"]: x["spans"] for x in secret_report(docs).collect()}
    for i, k in enumerate(keys):
        assert got[i] == f"live:4:{4 + len(k)}"
    assert all(got[6 + i] == "" for i in range(5))
    assert got[11] == f"live:4:{4 + len(encrypted)}"
    assert got[13] == "live:4:504"
    out = {x["doc_id"]: x["text"] for x in redact(docs).collect()}
    assert all(out[i] == "key [SECRET] end" for i in [*range(6), 11])
    assert out[12] == '[SECRET]" end'


def test_many_matches_take_linear_time(spark):
    import time

    text = "é " + " ".join(f"token={i:06d}abc and deadbeefdeadbeefdeadbeef{i:06d} x" for i in range(5_000))
    docs = frame(spark, [(1, text), (2, "token=abcdefgh")])
    begin = time.time()
    got = {r["doc_id"]: r for r in secret_report(docs).collect()}
    assert (got[1]["n_assign"], got[1]["n_hex"]) == (5_000, 5_000) and got[1]["base_sha256"] == brute(text)[0][3]
    out = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert out[1] == "é " + " ".join([f"{REDACTED} and {REDACTED} x"] * 5_000) and out[2] == REDACTED
    assert time.time() - begin < 40
