import hashlib
import itertools
import re

import duckdb
import numpy as np

from echofold.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


CASES = [
    None, "", "é𝄞 a.b@c.d-e.f, x", "a@b.c._x@d.e@f.g", "a@b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1 1.2.3", "4111 1111-1111 1111 4111111111111112",
    "+1 (743) 555-3824 +1 +12345678 +1((((", "4111111111111111", "+49 30 1234567890 123 45", "x@y.z" * 50, "@" * 2000, "1" * 3000, "1." * 2000, "a" * 50000,
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### 4785380592391139$$$ 152.143.123.131###',
]


def test_base_spans_equal_the_plain_patterns():
    rng = np.random.default_rng(0)
    texts = [t or "" for t in CASES] + ["".join(rng.choice(list("12.@-+( a%"), 60)) for _ in range(3000)]
    for t in texts:
        assert pii.written(pii.base_spans(t)) == brute(t), t


def test_field_adds_what_patterns_miss():
    texts = ['the token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and', "mail ann.lee (at) host (dot) org today", "call (555) 123-4567 now", "pay 4111.1111.1111.1111 soon", "In 2024 there were 12 of 300, at 10:30 and $4.50. Then v1.2.3 came."]
    got = [[(pii.KINDS[k], t[s:e]) for k, s, e in a if (k, s, e) not in b] for t, (b, a) in zip(texts, pii.spans(texts), strict=True)]
    assert got[0] == [("secret", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    assert got[1] == [("email", "ann.lee (at) host (dot) org")]
    assert got[2] == [("phone", "(555) 123-4567")]
    assert got[3] == [("card", "4111.1111.1111.1111")]
    assert got[4] == []


def test_viterbi_against_brute_force():
    field = pii.trained()
    rng = np.random.default_rng(2)
    seqs = [rng.normal(0, 3, (n, len(pii.LABELS))) for n in (1, 2, 3, 3)]
    for e, path in zip(seqs, field.viterbi(seqs), strict=True):
        score = lambda p, e=e: field.start[p[0]] + sum(e[t, y] for t, y in enumerate(p)) + sum(field.step[a, b] for a, b in itertools.pairwise(p))
        assert abs(score(path) - max(map(score, itertools.product(range(len(pii.LABELS)), repeat=len(e))))) < 1e-9


def test_held_out_labels():
    table = pii.labelled_table(200, seed=99)
    field = pii.trained()
    paths = field.viterbi(field.emission([t for t, _ in table]))
    right = [pii.LABELS[y] == g for p, (_, labels) in zip(paths, table, strict=True) for y, g in zip(p, labels, strict=True)]
    assert np.mean(right) > 0.97


def test_find_and_redact(spark):
    rows = [(k, t, "n") for k, t in enumerate(CASES)] + [(0, CASES[-1], None), (None, CASES[8], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.find(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id}
    for k, t, _ in rows[1 : len(CASES)]:
        assert by[k].base_sha256 == hashlib.sha256(brute(t or "").encode()).hexdigest()
        assert by[k].n_email == brute(t or "").count("email:")
        assert set(filter(None, brute(t or "").split(","))) <= set(by[k].spans.split(","))
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert out[len(CASES) - 1].text == 'token = "<SECRET>"### <CARD>$$$ <IP>###'
    assert pii.redact(df).columns == df.columns and out[1].text == ""
    assert pii.find(df.limit(0)).collect() == []


def test_more_kinds():
    texts = [
        "Passport no. C01234567, issued in Bonn", "please pay to IBAN DE89370400440532013000 today", "iban: GB82 WEST 1234 5698 7654 32 thanks", "mobile 01712345678 or",
        "the number 01712345678 alone", "IBAN DE89370400440532013001 is mistyped", "flight AB1234567 leaves",
    ]
    got = [[(pii.KINDS[k], t[s:e]) for k, s, e in a if (k, s, e) not in b] for t, (b, a) in zip(texts, pii.spans(texts), strict=True)]
    assert got == [[("document", "C01234567")], [("iban", "DE89370400440532013000")], [("iban", "GB82 WEST 1234 5698 7654 32")], [("phone", "01712345678")], [], [], []]


def test_gate_loses_nothing():
    """Decoding around tokens that give reason finds what decoding everything finds."""
    field = pii.trained()
    texts = [" ".join(t) for t, _ in pii.labelled_table(300, seed=5)]
    texts += [r for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' where text is not null").fetchnumpy()["text"]]
    base = [pii.base_spans(t) for t in texts]
    assert list(map(sorted, pii.added_spans(texts, base, field))) == list(map(sorted, pii.added_spans(texts, base, field, gate=False)))
