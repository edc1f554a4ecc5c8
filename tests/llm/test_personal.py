"""Personal data against plain searches and a plain model in Python."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnstone.llm import catalog, personal

SF = "/root/testdata/sf0.001"
# the base rule as stated, without what makes it linear
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(reversed(digits))) % 10 == 0


def sound(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def base(text):
    return [(k, m.start(), m.end(), m.group()) for k, kind in enumerate(personal.KINDS) for m in re.finditer(PLAIN[kind], text or "") if sound(kind, m.group())]


def listing(spans):
    return ",".join(f"{personal.KINDS[s[0]]}:{s[1]}:{s[2]}" for s in spans)


def votes(kind, m, before, after):
    s = lambda p, x: bool(re.search(p, x, re.A))
    digits = re.sub("[^0-9]", "", m)
    sign = lambda yes: 1 if yes else -1
    check = {"email": len(m) <= 254 and ".." not in m, "ip": s(personal.OCTETS, m), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 13}[kind]
    listed = {"email": sign(s(personal.LISTED["email"], m)), "ip": -sign(s(personal.LISTED["ip"], m)), "card": sign(s(personal.LISTED["card"], digits)), "phone": sign(s(personal.LISTED["phone"], m)) if m[0] == "+" else 0}[kind]
    left = 1 if s(r"(?:^|[\s(\[<,;:\"'])$", before) else -1 if s(r"[=/#_&@\\$-]$", before) else 0
    right = sign(s(r"^(?:$|[\s,.;:)\]>!?\"'])", after))
    cue = -1 if s(personal.COUNTER_CUE, before) else int(s(rf"(?i)(?:^|[^A-Za-z])(?:{personal.CUES[kind]})", before))
    return (sign(s(personal.FORM[kind], m)), sign(check), listed, left, right, cue, -int(s(personal.DUMMY, m)))


def candidates(text):
    out = []
    for k, kind in enumerate(personal.KINDS):
        found = list(re.finditer(personal.WIDE[kind], text or ""))
        for i, m in enumerate(found):
            before = text[found[i - 1].end() if i else 0 : m.start()][-personal.BEFORE :]
            after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else None][: personal.AFTER]
            line = (not before or before[-1] == "\n") and (not after or after == "\n")
            out.append((k, m.start(), m.end(), m.group(), votes(kind, m.group(), before, after), line))
    return out


def model(found):
    """Scores by kind, votes and line, from all candidates."""
    counted = Counter((c[0], c[4], c[5]) for c in found)
    scores, sigma = {}, lambda x: 1 / (1 + np.exp(-x))
    for k in range(len(personal.KINDS)):
        rows = [(v, line, n) for (kind, v, line), n in counted.items() if kind == k]
        if not rows:
            continue
        n, vote = np.array([r[2] for r in rows], float), np.array([r[0] for r in rows])
        hit = (vote[:, :, None] == np.array([-1, 0, 1])).astype(float)
        usual = (np.einsum("r,rjv->jv", n, hit) + 1e-3) / (n.sum() + 3e-3)
        tilt = personal.TILT ** np.array([-1.0, 0.0, 1.0])
        belief = np.stack([usual / tilt, usual * tilt])
        belief /= belief.sum(2, keepdims=True)
        prior, rates = 0.5, belief
        for turn in range(personal.TURNS + 1):
            p = sigma(np.log(prior / (1 - prior)) + np.einsum("rjv,jv->r", hit, np.log(rates[1] / rates[0])))
            if turn < personal.TURNS:
                prior = ((n * p).sum() + 1) / (n.sum() + 2)
                rates = np.stack([np.einsum("r,rjv->jv", n * (1 - p), hit), np.einsum("r,rjv->jv", n * p, hit)]) + personal.BELIEF * belief
                rates /= rates.sum(2, keepdims=True)
        x = np.array([[1, v[0] == 1, v[1] == 1, v[2] == 1, v[3] == -1, v[4] == -1, v[5] == 1, v[5] == -1, v[6] == -1, line] for v, line, _ in rows], float)
        w = np.zeros(x.shape[1])
        for _ in range(personal.STEPS):
            s = sigma(x @ w)
            h = (x * (n * s * (1 - s))[:, None]).T @ x + personal.RIDGE * np.eye(len(w))
            w = np.clip(w + np.linalg.solve(h, x.T @ (n * (p - s)) - personal.RIDGE * w), -30, 30)
        scores |= {(k, v, line): float(s) for (v, line, _), s in zip(rows, sigma(x @ w), strict=True)}
    return scores


def all_spans(text, scores):
    own = base(text)
    cross = lambda a, b: a[1] < b[2] and b[1] < a[2]
    new = [(*c[:4], scores[c[0], c[4], c[5]]) for c in candidates(text)]
    new = [c for c in new if c[4] >= personal.ACCEPT and not any(cross(b, c) for b in own)]
    new = [c for c in new if not any(cross(o, c) and (-o[4], o[0]) < (-c[4], c[0]) for o in new)]
    return sorted([s[:3] for s in own] + [s[:3] for s in new])


def expected(texts):
    scores = model([c for t in texts for c in candidates(t)])
    out = []
    for t in texts:
        own = base(t)
        counts = Counter(s[0] for s in own)
        out.append((*(counts[k] for k in range(4)), hashlib.sha256(listing(own).encode()).hexdigest(), listing(all_spans(t, scores))))
    return out


CARD, OTHER = "4111 1111 1111 1111", "4845168114407329"
TEXTS = [
    None, "", "nothing here", "a.b@c.de", "a@b.c+d@e.f x@y", "1.2.3.4.5 256.1.1.1 0010.0.0.255 1.2.3", f"pay {CARD}, {OTHER}.", f"{OTHER} {OTHER}", f"+1 (826) 555-4081 190.137.223.204", "tel 555-123-4567", "+49 (30) 1234567",
    "mail: jo (at) host (dot) org", 'token = "2390409500648960"', "+1+1+1 22 333 4444", "人@x.de 人a@x.de 😀 +33 (012) 345-6789", "x" * 50 + " 1 2 3 4 5 6 7 8 9 0 " * 3, "378282246310005", OTHER, OTHER, "a@b@c.d..e@f.g",
]


@pytest.fixture(scope="module")
def fuzz():
    rng = random.Random(12)
    parts = [CARD, OTHER, "+1 (017) 555-7713", "190.137.223.204", "x.1@m.com", "@", "+", "-", ".", " ", "\n", "(", ")", "12", "7", "999", "é", "a", "=", "token ", "mail "]
    return ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(400)]


def frame(spark, texts):
    rows = [(k % 7 or None, t, "b", "c", 1) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, base string, candidates string, kind int").repartition(3)


def test_report(spark, fuzz):
    texts = TEXTS + fuzz
    got = Counter(tuple(r)[1:] for r in personal.report(frame(spark, texts)).collect())
    assert got == Counter(expected(texts))


def test_spans_that_only_the_method_finds(spark, fuzz):
    rows = personal.found(frame(spark, TEXTS + fuzz))
    out = personal.spans(rows, personal.fit(rows)).select(F.explode("spans").alias("s")).filter("s.score is not null").select("s.*").collect()
    assert out and all(r.score >= personal.ACCEPT for r in out) and {"card", "phone"} <= {personal.KINDS[r.kind] for r in out}


def test_empty_table(spark):
    assert personal.report(frame(spark, TEXTS).limit(0)).collect() == []


def test_running_sums(spark):
    for n in (0, 1, personal.STRIDE, personal.STRIDE + 1, 3 * personal.STRIDE + 7):
        df = spark.createDataFrame([([k % 5 for k in range(n)],)], "x array<long>")
        assert df.select(personal.running(F.col("x"))).first()[0] == list(np.cumsum([k % 5 for k in range(n)], dtype=int))


def test_long_texts(spark):
    """Runs that would take quadratic time or deep recursion, and many spans in one text."""
    texts = ["7" * 400_000, "7 " * 200_000, "a" * 400_000 + "@", "1." * 200_000, "+" * 200_000 + "1", "(1" * 100_000, "a@" * 100_000, "x.1@m.com, 8.8.8.8 " * 5000]
    rows = personal.found(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r for r in rows.select("doc_id", F.size("base").alias("spans"), F.try_element_at("base", F.lit(-1)).alias("end")).collect()}
    assert len(got) == len(texts)
    last = got[len(texts) - 1]
    assert last.spans == 10_000 and last.end.stop == len(texts[-1]) - 1


def test_query_and_plan(spark):
    out = catalog.op12_personal(spark, SF)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], expected([d.text for d in docs]), strict=True))
    assert {r.doc_id: tuple(r)[1:] for r in out.collect()} == want
