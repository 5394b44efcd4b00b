import hashlib
import re

from tickloom.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        t += v - 9 * (v > 9)
    return t % 10 == 0


def base(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x for *_, x in sorted(out)]


AWKWARD = [
    (1, None), (2, ""), (3, "mail a@b.c@d.e and a@b.c_d@e.f, x@y"), (3, "mail a@b.c@d.e and a@b.c_d@e.f, x@y"), (None, "1.2.3.4"),
    (4, "1.2.3.4.5.6.7.8 256.1.1.1 0.00.000.0255 1.1.1.0256"), (5, "é😀 +1 (659) 555-6997 ü 4364946870907603 and 4364-9468-7090-7603, 4364  9468"),
    (6, "1 2 3 4 5 6 7 8 9 " * 4000), (7, "9" * 30_000), (8, "a" * 30_000 + "@b.co"), (9, "+12 345 678 9+44 20 7946 0958 +1.2.3.4.5.6.7.8.9"),
    (10, "call (659) 555-6997 or jane at example dot com, card 4111 1111 1111 1111-"), (11, "4111\n1111 1111 1111 1111"), (12, "x@y." + "a." * 9000),
]


def check(rows, got):
    assert sorted((r.doc_id or -1, r.base_sha256, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got) == sorted(
        (i or -1, hashlib.sha256(",".join(b).encode()).hexdigest(), *(sum(x.startswith(k) for x in b) for k in PATTERNS)) for i, b in ((i, base(t)) for i, t in rows)
    )
    texts = {}
    for i, t in rows:
        texts.setdefault((i, hashlib.sha256(",".join(base(t)).encode()).hexdigest()), set()).update(base(t))
    for r in got:
        assert texts[r.doc_id, r.base_sha256] <= set(r.spans.split(",")) - {""}


def test_awkward_texts(spark, make, on_disk):
    d = on_disk(documents=make(AWKWARD, clash=("found", "base", "fold", "kind")))
    check(AWKWARD, queries.QUERIES["op10_candidate_boosting"](spark, d).collect())


def test_whole_table(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    check(rows, queries.QUERIES["op10_candidate_boosting"](spark, d).collect())


def test_learned_spans_and_redaction(make):
    rows = [(i, f"phone +1 (659) 555-{1000 + i} or mail u{i}@x.org") for i in range(300)]
    rows += [(1000 + i, f"order 4111-1111-1111-{1000 + i:04d} ref 999.{i}.999.1") for i in range(300)]
    rows += [(5000, "please call (212) 555-0188 now"), (5001, "please write to jane at example dot com now")]
    docs = make(rows)
    found = pii.detect(docs)
    got = {r.doc_id: r.spans for r in found.where("doc_id >= 5000").collect()}
    assert [(s.kind, s.start, s.end) for s in got[5000]] == [("phone", 12, 26)]
    text = {r.doc_id: r.text for r in pii.redact(docs, found).where("doc_id >= 5000 or doc_id = 7").collect()}
    assert text[5000] == "please call [phone] now" and text[7] == "phone [phone] or mail [email]"


def test_empty(make):
    assert pii.detect(make(AWKWARD).where("false")).collect() == []
