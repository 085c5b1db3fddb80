from __future__ import annotations

import hashlib
import random
import re

from fixtures import empty, frame, sentence, texts

from cladeflow.llm.pii import base_spans, pii_report, revealing_terms, sanitise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    found = [int(c) for c in digits]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(found))) % 10 == 0


def brute(text):
    """The base matches by the contract's own patterns."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    keep = [
        ("email", EMAIL, lambda x: True), ("ip", IP, lambda x: all(int(p) <= 255 for p in x.split("."))),
        ("card", CARD, lambda x: 13 <= len(digits(x)) <= 19 and luhn(digits(x))), ("phone", PHONE, lambda x: 9 <= len(digits(x)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in keep for m in p.finditer(text or "") if ok(m[0])]


def rows():
    r = random.Random(21)
    values = [
        "a.b@c.de", "@x.com@y.com", "a@b@c.d.e", "x@y", "me@mail.example.com.", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "001.02.3.0255", "4111 1111 1111 1111",
        "4111-1111-1111-1111-", "41111111111111112", "+1 (017) 555-7713", "+4", "+12 34", "+1 2 3 4 5 6 7 8 9 ()", "5500005555555559", "0" * 30, "é@ü.de", "..@a-.b_c.d",
    ]
    out = texts(21)
    for i in range(120):
        out.append((5000 + i, r.choice([" ", "é ", "\n", "", "😀"]).join([sentence(r, 4), *[r.choice(values) for _ in range(r.randrange(1, 6))], sentence(r, 3)])))
    return out


def named(n_other=400):
    """An address with its owner's name in five contexts, and prose without."""
    r = random.Random(5)
    out = [(7000 + i, f"{sentence(r, 30)} Zebediah Quill writes from zq.{1}@mail.example.org {sentence(r, 30)} 東京") for i in range(5)]
    out += [(7100, f"{sentence(r, 20)} asked zebediah, again {sentence(r, 20)}")]
    out += [(8000 + i, f"{sentence(r, 40)} reach us at desk@office.example.org {sentence(r, 5)}") for i in range(30)]
    return out + [(9000 + i, sentence(r, 60) + " reach us at" * (i % 2)) for i in range(n_other)]


def test_base_spans_equal_brute_force(spark):
    given = rows()
    for _, t in given:
        text = t or ""
        points = {len(text[:i].encode()): i for i in range(len(text) + 1)}
        assert [(("email", "ip", "card", "phone")[k], points[s], points[e]) for k, s, e in base_spans(text.encode())] == brute(text)
    want = []
    for d, t in given:
        told = ",".join(f"{k}:{s}:{e}" for k, s, e in brute(t))
        want.append((d, *(sum(x[0] == k for x in brute(t)) for k in ("email", "ip", "card", "phone")), hashlib.sha256(told.encode()).hexdigest(), told))
    got = pii_report(frame(spark, given)).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((w[:6] for w in want), key=repr)
    by_id = {r["doc_id"]: r["spans"].split(",") for r in got}
    for w in want:
        assert w[0] in (200, None, 603, 604) or by_id[w[0]][: len(w[6].split(",")) if w[6] else 0] == [x for x in w[6].split(",") if x]


def test_names_that_disclose_are_found_everywhere(spark):
    given = named()
    docs = frame(spark, given)
    terms = {r["term"]: r["disclosure"] for r in revealing_terms(docs).collect()}
    assert {"zebediah", "quill", "zebediah quill"} <= set(terms) and all(0.75 <= v <= 1.0001 for v in terms.values())
    got = {r["doc_id"]: r for r in pii_report(docs).collect()}
    text = dict(given)
    marked = {d: [text[d][int(a) : int(b)] for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k == "term"] for d, r in got.items()}
    assert all("Zebediah Quill" in " ".join(marked[7000 + i]) for i in range(5))
    assert marked[7100] == ["zebediah"]
    assert not any(m for d, m in marked.items() if d >= 8000)


def test_sanitise(spark):
    given = [*named(), (1, None), (2, ""), (3, "nothing here")]
    docs = frame(spark, given)
    out = sanitise(docs)
    assert out.schema == docs.schema
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(given)
    for d, t in given:
        new = got[d]["text"]
        assert t is None and new is None or "@" not in new and "ebediah" not in new and "Quill" not in new
        if t is not None and t != new:
            assert got[d]["n_chars"] == len(new) and "[EMAIL]" in new or d == 7100
    assert got[3]["text"] == "nothing here" and got[7003]["text"].endswith("東京")


def test_terms_that_meet_texts_in_a_shuffle_give_the_same(spark):
    docs = frame(spark, [*named(60), *named(3), (None, "asked Zebediah")])
    order = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert order(pii_report(docs)) == order(pii_report(docs, broadcast_terms=0))
    text = lambda df: sorted(r["text"] for r in df.collect())
    assert text(sanitise(docs)) == text(sanitise(docs, broadcast_terms=0))


def test_long_texts_take_linear_time():
    import time

    begin = time.time()
    for text in (b"a" * 1_000_000, b"1" * 1_000_000, b"1." * 500_000, b"1 " * 500_000, b"+1(" * 300_000, b"@a" * 500_000, b"a@b.c " * 100_000, b"." * 10**6):
        base_spans(text)
    assert time.time() - begin < 20


def test_empty_table(spark):
    assert pii_report(empty(spark)).collect() == [] and sanitise(empty(spark)).collect() == []
