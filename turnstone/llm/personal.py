"""Personal data in texts by weak supervision, DataFrame operations only.

Spans of a base rule (a pattern and a check for each kind) always stay. Beside
them wider patterns find candidates, on which labelers vote yes, no or nothing:
patterns (form and checksum), gazetteers (domain endings, address ranges, issuers, calling codes,
dummies) and context (what stands right before and after, cue words). Votes are counted by
pattern of votes, at most 4 * 3**7 * 2 rows whatever the corpus has.
Expectation-maximisation over these rows estimates the prior of each kind and how often each labeler
votes how on true and on false candidates; a logistic classifier for each kind
is then trained on the posteriors by Newton's method. Both are aggregations by Spark with a few hundred
numbers each; only these reach the driver. A candidate that the classifier accepts is added if it overlaps no base
span and no better candidate.

Patterns can't run away: repetitions are possessive or bounded, and a run of letters or
digits is entered at its start only, so time is linear in a text's length. Positions are
sums of the lengths between matches, added up in two steps.

Defined cases: a null text is empty; null ids and equal rows are kept as rows; an empty text has
no spans; empty tables give no rows. Matches of the base patterns that fail their check are
dropped whole. Other columns are ignored. Positions count code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

KINDS = ["email", "ip", "card", "phone"]
# The base patterns; possessive, and entered at the start of a run, where that can't change what they match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
# Wider ones for candidates: of bounded length, standing alone.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]{1,63}+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]{1,63}+){0,4}+",
    "ip": r"(?<![0-9A-Za-z.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3}+(?![0-9A-Za-z]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.])\+?(?:[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.-][0-9])",
}
#: What a text must have for any pattern to match.
ANY = r"[0-9@]|[\[(]at[\])]"
#: Code points before and after a candidate that context labelers see.
BEFORE, AFTER = 32, 1

OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"
FORM = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$",
    "ip": r"^(?:(?:0|[1-9][0-9]{0,3})(?:\.|$)){4}$",
    "card": r"^(?:[0-9]{15,16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$",
    "phone": r"^\+|\(",
}
# Gazetteers: domain endings, special address ranges (a vote against), beginnings of card numbers, calling codes.
LISTED = {
    "email": r"\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|ch|at|it|nl|us|ca)$",
    "ip": r"^(?:0|10|127|22[4-9]|2[34][0-9]|25[0-5])\.|^192\.168\.|^169\.254\.|^172\.(?:1[6-9]|2[0-9]|3[01])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30[0-5]|3[68])",
    "phone": r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])",
}
DUMMY = r"^([0-9])[ .-]?(?:\1[ .-]?)*$|^1234[ -]?5678|^0\.0\.0\.0$|^127\.0\.0\.1$|^(?:test|example|foo|user|noreply|no-reply)@"
CUES = {
    "email": "mail|courriel|correo|contact|kontakt|write|schreib",
    "ip": "ip|server|host|address|adresse|network",
    "card": "card|visa|master|amex|karte|carte|tarjeta|credit|kredit|pay",
    "phone": "tel|phone|call|fax|mobil|ruf|appel|llam",
}
COUNTER_CUE = r"(?i)(?:^|[^A-Za-z])(?:token|hash|sha|key|version|isbn|issn|order|serial|id|ref|sku|uuid|build)[^A-Za-z0-9]{0,3}$"
LABELERS = ["form", "check", "listed", "left", "right", "cue", "dummy"]

#: Turns of expectation-maximisation and of Newton's method; weight in rows and strength of the prior belief that labelers vote right; ridge; score from which a candidate is added.
TURNS, STEPS, BELIEF, TILT, RIDGE, ACCEPT = 8, 6, 10.0, 3.0, 1.0, 0.75


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Lengths that are added up one by one; beyond, sums of so many are.
STRIDE = 256


def running(lengths: Column) -> Column:
    """The running sums of an array of longs, in steps that grow as n * STRIDE + (n / STRIDE) ** 2."""

    def sums(xs: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(xs, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out")))["out"]

    cut = lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(xs) - 1) / STRIDE).cast("int"), F.lit(0))), lambda k: sums(F.slice(xs, k * STRIDE + 1, STRIDE)))
    last = lambda parts: sums(F.transform(parts, lambda p: F.try_element_at(p, F.lit(-1))))
    return let(lengths, lambda xs: let(cut(xs), lambda parts: let(last(parts), lambda ends: F.flatten(F.transform(parts, lambda p, k: F.transform(p, lambda x: x + F.when(k > 0, F.get(ends, k - 1)).otherwise(F.lit(0).cast("long"))))))))


_SPANS = "array<struct<start:bigint,stop:bigint,text:string,before:string,after:string>>"


def matches(text: Column, pattern: str) -> Column:
    """start, stop, text of each match, with what stands before and after it up to the next matches."""

    def placed(found: Column) -> Column:
        def at(gaps: Column) -> Column:
            def one(ends: Column) -> Column:
                return F.transform(found, lambda m, k: F.struct((F.get(ends, k) - F.length(m)).alias("start"), F.get(ends, k).alias("stop"), m.alias("text"), F.right(F.get(gaps, k), F.lit(BEFORE)).alias("before"), F.left(F.get(gaps, k + 1), F.lit(AFTER)).alias("after")))

            return let(running(F.transform(found, lambda m, k: (F.length(m) + F.length(F.get(gaps, k))).cast("long"))), one)

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), at)).otherwise(F.array().cast(_SPANS))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def luhn(digits: Column) -> Column:
    """Whether a text of digits, of bounded length, has a valid check digit."""
    doubled = "0246813579"
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, k: F.when(k % 2 == 1, F.translate(c, "0123456789", doubled)).otherwise(c).cast("int"))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _between(x: Column, low: int, high: int, then: Callable[[Column], Column] | None = None) -> Column:
    n = F.length(x)
    return F.when((n >= low) & (n <= high), then(x) if then else F.lit(True)).otherwise(F.lit(False))


def passes(kind: str, m: Column) -> Column:
    """Whether a match of the base pattern passes the check of its kind."""
    if kind == "ip":
        return m.rlike(OCTETS)
    if kind == "card":
        return let(_digits(m), lambda d: _between(d, 13, 19, luhn))
    if kind == "phone":
        return _between(_digits(m), 9, 15)
    return F.lit(True)


def _vote(yes: Column, otherwise: Column | int = -1) -> Column:
    return F.when(yes, F.lit(1)).otherwise(F.lit(otherwise) if isinstance(otherwise, int) else otherwise)


def votes(kind: str, c: Column) -> Column:
    """An array of 1 (personal), -1 (not) and 0 (no vote), one for each of LABELERS."""
    text, digits = c["text"], _digits(c["text"])
    check = {"email": (F.length(text) <= 254) & ~F.contains(text, F.lit("..")), "ip": text.rlike(OCTETS), "card": let(digits, lambda d: _between(d, 13, 19, luhn)), "phone": _between(digits, 10, 13)}[kind]
    listed = {
        "email": _vote(text.rlike(LISTED["email"])),
        "ip": -_vote(text.rlike(LISTED["ip"])),
        "card": _vote(digits.rlike(LISTED["card"])),
        "phone": F.when(text.startswith("+"), _vote(text.rlike(LISTED["phone"]))).otherwise(F.lit(0)),
    }[kind]
    left = F.when(c["before"].rlike(r"(?:^|[\s(\[<,;:\"'])$"), 1).when(c["before"].rlike(r"[=/#_&@\\$-]$"), -1).otherwise(0)
    right = _vote(c["after"].rlike(r"^(?:$|[\s,.;:)\]>!?\"'])"))
    cue = F.when(c["before"].rlike(COUNTER_CUE), -1).when(c["before"].rlike(rf"(?i)(?:^|[^A-Za-z])(?:{CUES[kind]})"), 1).otherwise(0)
    return F.array(_vote(text.rlike(FORM[kind])), _vote(check), listed, left, right, cue, F.when(text.rlike(DUMMY), -1).otherwise(0))


def found(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id; base: kind, start, stop, text of the base spans; candidates: the same with votes and whether they are a line of their own."""
    text = F.col("text")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def base(k: int, kind: str) -> Column:
        spans = F.filter(matches(text, BASE[kind]), lambda s: passes(kind, s["text"]))
        return F.transform(spans, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["text"].alias("text")))

    def wide(k: int, kind: str) -> Column:
        line = lambda s: s["before"].rlike(r"(?:^|\n)$") & s["after"].rlike(r"^(?:$|\n)")
        return F.transform(matches(text, WIDE[kind]), lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["text"].alias("text"), votes(kind, s).alias("votes"), line(s).alias("line")))

    some = lambda each, empty: F.when(text.rlike(ANY), F.concat(*(each(k, kind) for k, kind in enumerate(KINDS)))).otherwise(F.array().cast(empty))
    span = "kind:int,start:bigint,stop:bigint,text:string"
    return docs.select("doc_id", some(base, f"array<struct<{span}>>").alias("base"), some(wide, f"array<struct<{span},votes:array<int>,line:boolean>>").alias("candidates"))


FEATURES = ["one", "form", "check", "listed", "bad_left", "bad_right", "cue", "counter_cue", "dummy", "line"]


def features(vote: Column, line: Column) -> list[Column]:
    """The classifier's inputs, each 0 or 1, in the order of FEATURES."""
    at = lambda name: F.get(vote, F.lit(LABELERS.index(name)))
    tests = [at("form") == 1, at("check") == 1, at("listed") == 1, at("left") == -1, at("right") == -1, at("cue") == 1, at("cue") == -1, at("dummy") == -1, line]
    return [F.lit(1.0), *(t.cast("double") for t in tests)]


@dataclass(frozen=True)
class Model:
    """weights: of each kind's classifier. priors and rates: what the labelers' reliabilities were found to be, rates by kind, labeler, vote + 1 and truth."""

    weights: np.ndarray
    priors: np.ndarray
    rates: np.ndarray

    def score(self, kind: Column, vote: Column, line: Column) -> Column:
        return _logistic(sum((f * _at(self.weights[:, j], kind) for j, f in enumerate(features(vote, line))), F.lit(0.0)))


def _at(values: np.ndarray, index: Column) -> Column:
    return F.get(F.array(*(F.lit(float(v)) for v in values.ravel())), index)


def _logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def patterns(rows: DataFrame) -> DataFrame:
    """kind, votes, line, n: how many candidates have the same votes. A bounded number of rows, so one file."""
    each = rows.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.line")
    return each.groupBy("kind", "votes", "line").agg(F.count("*").alias("n")).coalesce(1).sortWithinPartitions("kind", "votes", "line")


def fit(rows: DataFrame) -> Model:
    """rows: those of found(). Reliabilities by expectation-maximisation, then a classifier for each kind on the posteriors."""
    counted = stored(patterns(rows))
    n_kinds, n_labelers = len(KINDS), len(LABELERS)
    vote = lambda j: F.get("votes", F.lit(j))
    kinds, choices = range(n_kinds), (-1, 0, 1)

    def sums(weight: Column | str) -> np.ndarray:
        """By kind, labeler and vote: the candidates, weighted."""
        each = [F.sum(F.when(vote(j) == v, F.col("n") * weight).otherwise(F.lit(0.0))) for j in range(n_labelers) for v in choices]
        rows = {r[0]: r[1:] for r in counted.groupBy("kind").agg(*each).collect()}
        return np.array([rows.get(k, [0.0] * len(each)) for k in kinds], float).reshape(n_kinds, n_labelers, 3)

    every = sums(F.lit(1.0))
    total = every[:, 0].sum(-1)
    # before any posterior, a labeler votes on true and false candidates as on all, tilted to what it means to say; one that always votes the same says nothing
    usual = (every + 1e-3) / (every + 1e-3).sum(-1, keepdims=True)
    belief = np.stack([usual * TILT ** -np.array(choices, float), usual * TILT ** np.array(choices, float)], -1)
    belief /= belief.sum(2, keepdims=True)
    priors, rates = np.full(n_kinds, 0.5), belief
    for turn in range(TURNS + 1):
        odds = _at(np.log(priors / (1 - priors)), F.col("kind"))
        for j in range(n_labelers):
            odds = odds + _at(np.log(rates[:, j, :, 1] / rates[:, j, :, 0]), F.col("kind") * 3 + vote(j) + 1)
        posterior = _logistic(odds)
        if turn < TURNS:
            true = sums(posterior)
            priors = (true[:, 0].sum(-1) + 1) / (total + 2)
            rates = np.stack([every - true, true], -1) + BELIEF * belief
            rates /= rates.sum(2, keepdims=True)
    weights = np.zeros((n_kinds, len(FEATURES)))
    columns = features(F.col("votes"), F.col("line"))
    taught = counted.select("kind", "n", posterior.alias("p"), *(f.alias(x) for f, x in zip(columns, FEATURES, strict=True)))
    upper = [(a, b) for a in range(len(FEATURES)) for b in range(a, len(FEATURES))]
    for _ in range(STEPS):
        s = _logistic(sum((F.col(x) * _at(weights[:, j], F.col("kind")) for j, x in enumerate(FEATURES)), F.lit(0.0)))
        step = taught.withColumn("s", s)
        slope = [F.sum(F.col("n") * (F.col("p") - F.col("s")) * F.col(x)).alias(f"g{j}") for j, x in enumerate(FEATURES)]
        bend = [F.sum(F.col("n") * F.col("s") * (1 - F.col("s")) * F.col(FEATURES[a]) * F.col(FEATURES[b])).alias(f"h{a}_{b}") for a, b in upper]
        for r in step.groupBy("kind").agg(*slope, *bend).collect():
            h = np.zeros((len(FEATURES), len(FEATURES)))
            for a, b in upper:
                h[a, b] = h[b, a] = r[f"h{a}_{b}"]
            g = np.array([r[f"g{j}"] for j in range(len(FEATURES))]) - RIDGE * weights[r.kind]
            weights[r.kind] = np.clip(weights[r.kind] + np.linalg.solve(h + RIDGE * np.eye(len(FEATURES)), g), -30, 30)
    discard(counted)
    return Model(weights, priors, rates)


def spans(rows: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """doc_id, base, spans: kind, start, stop, text and score (null for base spans) in the order of kind and start."""
    overlap = lambda a, b: (a["start"] < b["stop"]) & (b["start"] < a["stop"])
    scored = F.transform("candidates", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), c["text"].alias("text"), model.score(c["kind"], c["votes"], c["line"]).alias("score")))
    likely = F.filter(scored, lambda c: c["score"] >= accept)

    def added(new: Column) -> Column:
        free = F.filter(new, lambda c: ~F.exists("base", lambda b: overlap(b, c)))
        first = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (a["kind"] < b["kind"]))
        return let(free, lambda f: F.filter(f, lambda c: ~F.exists(f, lambda o: overlap(o, c) & first(o, c))))

    # most candidates are base spans themselves, which hashing finds; only what is left is compared with spans
    place_of = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))
    fresh = let(likely, lambda xs: let(F.array_except(F.transform(xs, place_of), F.transform("base", place_of)), lambda new: F.filter(xs, lambda c: F.array_contains(new, place_of(c)))))
    own = F.transform("base", lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["stop"].alias("stop"), b["text"].alias("text"), F.lit(None).cast("double").alias("score")))
    return rows.select("doc_id", "base", F.array_sort(F.concat(own, F.when(F.size("candidates") > 0, added(fresh)).otherwise(F.array().cast("array<struct<kind:int,start:bigint,stop:bigint,text:string,score:double>>")))).alias("spans"))


def listing(of: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(df: DataFrame, **columns: str) -> DataFrame:
    """doc_id, numbers of base spans by kind, base_sha256, spans (all of them) for each row."""
    rows = stored(found(df, **columns))
    out = spans(rows, fit(rows))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.sha2(listing(F.col("base")).cast("binary"), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"))
