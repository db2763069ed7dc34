"""Personal data by weak supervision, in DataFrame operations only.

Base spans follow fixed rules and always stay. Wider patterns propose further candidates; labelers (the strict
pattern, a structure check, a gazetteer, the words before, the signs around) vote on every candidate, base spans
included, for, against or not at all. Votes of all documents are counted by pattern - at most 3^5 patterns a kind,
whatever the input - and expectation-maximisation on that bounded table estimates each labeler's reliability. The
posteriors train a logistic span classifier, whose score is an expression over the votes; candidates that overlap
no base span and score ADD_AT or more are added.

One narrow stage finds spans and votes; nothing but the pattern counts is shuffled. Offsets are code points. Matches
and what is between them come from one search each; offsets are running sums of their lengths, by doubling steps, so
a text of n signs and m matches takes n + m log m steps, however many matches there are.

Defined cases: a null text is empty and has no spans; very long texts are searched whole, by patterns whose time
is linear in their length; repeated rows and null ids are searched like all others; an empty table gives an empty
result; other columns are ignored (`mask_documents` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm._common import stored

KINDS = ("email", "ip", "card", "phone")
#: The base rules, in a form that is linear in a text's length: a run of signs is entered at its start, or where the last match ended.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    # whole runs only, and of these only such with 16 to 19 digits
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be meant as well: spelt-out addresses, numbers beside other numbers or without a country code.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.]*[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[\x20-]?){3}[0-9]{4}(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[\x20.-]?)?(?<![0-9])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
# Word lists of the gazetteer and context labelers.
ENDINGS = "com|net|org|edu|gov|info|biz|io|de|fr|es|it|uk|nl|ch|at|eu|us|ca|au|jp|cn|ru|br|in|mx"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|35|36|38|6011|62|65"
COUNTRIES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
BEFORE = {
    "email": "e-?mail|mail|contact|kontakt|courriel|correo|write|to|from",
    "ip": "ip|host|server|address|adresse|direcci[oó]n|login|from",
    "card": "card|visa|mastercard|credit|karte|carte|tarjeta|payment|pay",
    "phone": "phone|tel|call|mobile|cell|fax|telefon|t[eé]l[eé]phone|tel[eé]fono|whatsapp",
}
AGAINST = "version|ver|isbn|issn|order|invoice|serial|sku|section|chapter|figure|table|doi"
LABELERS = ("strict", "structure", "gazetteer", "context", "around")
CONTEXT = 24
#: Code points of a chunk, from which masked texts are put together.
CHUNK = 256
ADD_AT = 0.5
ROUNDS = 50


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check: every second digit from the right doubled, their sums added."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _octets_fit(match: Column) -> Column:
    """Every part at most 255, leading zeros aside."""

    def fits(part: Column) -> Column:
        number = F.regexp_replace(part, "^0+", "")
        return (F.length(number) < 3) | ((F.length(number) == 3) & (number <= "255"))

    return F.forall(F.split(match, r"\."), fits)


def passes(kind: str, match: Column) -> Column:
    """What the base rule asks beyond its pattern."""
    if kind == "ip":
        return _octets_fit(match)
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def running(values: Column, both: Callable[[Column, Column], Column]) -> Column:
    """For each element the sum, maximum or the like of all up to it, by doubling steps. values: an array bound to a variable."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < F.size(values))
    return F.aggregate(steps, values, lambda so_far, d: F.transform(so_far, lambda x, i: F.when(i >= d, both(x, F.get(so_far, i - d))).otherwise(x)))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def located(text: Column, pattern: str, hint: Column) -> Column:
    """All matches from left to right: array of (start, end, match, before, after), end exclusive, in code points.

    before and after are what lies between this match and its neighbours.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("b"))

    def placed(s: Column) -> Column:
        n = F.size(s["m"])
        lengths = F.zip_with(s["m"], F.slice(s["b"], F.lit(1), n), lambda m, b: F.length(b) + F.length(m))
        ends = bound(lengths, lambda x: running(x, lambda p, q: p + q))
        each = F.zip_with(s["m"], ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("match")))
        each = F.zip_with(each, F.slice(s["b"], F.lit(1), n), lambda c, b: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match"), b.alias("before")))
        return F.zip_with(each, F.slice(s["b"], F.lit(2), n), lambda c, b: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["match"].alias("match"), c["before"].alias("before"), b.alias("after")))

    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")
    return F.when(hint, bound(found, lambda s: F.when(F.size(s["m"]) > 0, placed(s)).otherwise(none))).otherwise(none)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def votes(kind: str, span: Column, strict: Column) -> list[Column]:
    """Each labeler's vote: 1 for, -1 against, 0 none. The words before a match are those since the last match."""
    match = span["match"]
    digits = _digits(match)
    before = F.lower(F.right(span["before"], F.lit(CONTEXT)))
    # a match that follows another one at once is joined to it
    left = F.when((span["before"] == "") & (span["start"] > 0), "0").otherwise(F.right(span["before"], F.lit(1)))
    right = F.substring(span["after"], 1, 1)
    if kind == "email":
        structure, listed = match.rlike(r"^[^.].*[^.]\s?(?:@|\(at\)|\[at\])"), match.rlike(f"(?i)(?:\\.|dot[)\\]])\\s?(?:{ENDINGS})$")
    elif kind == "ip":
        structure, listed = _octets_fit(match), match.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.")
    elif kind == "card":
        structure, listed = luhn(digits), digits.rlike(f"^(?:{ISSUERS})")
    else:
        structure, listed = F.length(digits).between(8, 15), match.rlike(rf"^\+(?:{COUNTRIES})")
    word = before.rlike(rf"(?:^|[^\p{{L}}])(?:{BEFORE[kind]})[^\p{{L}}]*$")
    wrong = before.rlike(rf"(?:^|[^\p{{L}}])(?:{AGAINST})[^\p{{L}}]*$")
    joined = left.rlike(r"^[\p{L}0-9_]$") | right.rlike(r"^[\p{L}0-9_]$")
    listed_vote = _vote(listed, ~listed) if kind == "card" else _vote(listed, F.lit(False))
    return [_vote(strict, ~strict), _vote(structure, ~structure), listed_vote, _vote(word, wrong), _vote(~joined, joined)]


def candidates(text: Column) -> Column:
    """Per document: array of (start, end, kind, base, v0 .. v4), in order of start."""
    at, digit = F.contains(text, F.lit("@")), text.rlike("[0-9]")
    hints = {"email": at, "ip": digit, "card": digit, "phone": digit}
    wide_hints = hints | {"email": at | F.contains(text, F.lit("(at)")) | F.contains(text, F.lit("[at]"))}

    def base_of(n: int, kind: str) -> Column:
        found = F.filter(located(text, BASE[kind], hints[kind]), lambda s: passes(kind, s["match"]))
        return F.transform(found, lambda s: _candidate(n, kind, s, F.lit(True)))

    def wide_of(n: int, kind: str) -> Column:
        return F.transform(located(text, WIDE[kind], wide_hints[kind]), lambda s: _candidate(n, kind, s, F.lit(False)))

    every = F.concat(*[base_of(n, k) for n, k in enumerate(KINDS)], *[wide_of(n, k) for n, k in enumerate(KINDS)])
    none = F.array().cast("array<struct<start:int,end:int,kind:int,base:boolean,v0:int,v1:int,v2:int,v3:int,v4:int>>")
    found = bound(F.array_sort(every), lambda c: F.when(F.size(c) > 0, _apart(c)).otherwise(none))
    return F.when(digit | wide_hints["email"], found).otherwise(none)


def _apart(c: Column) -> Column:
    """All base spans, and the wide candidates that overlap none of them, of any kind. c: candidates in order of start."""
    far = 1 << 30
    ended = bound(F.transform(c, lambda x: F.when(x["base"], x["end"]).otherwise(0)), lambda e: running(e, lambda p, q: F.greatest(p, q)))
    to_come = F.reverse(bound(F.reverse(F.transform(c, lambda x: F.when(x["base"], x["start"]).otherwise(far))), lambda e: running(e, lambda p, q: F.least(p, q))))
    seen = F.zip_with(c, ended, lambda x, e: F.struct(x.alias("c"), e.alias("ended")))
    seen = F.zip_with(seen, to_come, lambda x, f: F.struct(x["c"].alias("c"), (x["c"]["base"] | ((x["ended"] <= x["c"]["start"]) & (f >= x["c"]["end"]))).alias("stays")))
    return F.transform(F.filter(seen, lambda x: x["stays"]), lambda x: x["c"])


def _candidate(n: int, kind: str, span: Column, base: Column) -> Column:
    strict = base if kind == "email" else passes(kind, span["match"]) & (base if kind == "phone" else F.lit(True))
    v = votes(kind, span, strict)
    return F.struct(span["start"].alias("start"), span["end"].alias("end"), F.lit(n).alias("kind"), base.alias("base"), *[x.cast("int").alias(f"v{i}") for i, x in enumerate(v)])


@dataclass
class SpanModel:
    """For each kind: the labelers' reliabilities and the classifier's weights."""

    reliability: dict[int, list[tuple[dict[int, float], dict[int, float]]]] = field(default_factory=dict)
    weights: dict[int, list[float]] = field(default_factory=dict)  # bias, then for and against of each labeler

    def score(self, c: Column) -> Column:
        out = F.lit(0.0)
        for kind, w in self.weights.items():
            total = reduce(lambda a, b: a + b, [F.when(c[f"v{i}"] == 1, w[1 + 2 * i]).when(c[f"v{i}"] == -1, w[2 + 2 * i]).otherwise(0.0) for i in range(len(LABELERS))], F.lit(w[0]))
            out = F.when(c["kind"] == kind, 1 / (1 + F.exp(-total))).otherwise(out)
        return out


def fit_em(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[dict[tuple[int, ...], float], list[tuple[dict[int, float], dict[int, float]]]]:
    """The chance that a candidate with these votes is meant, and for each labeler its vote's chances if so and if not.

    Votes count as independent given the truth; a few pseudo-votes of a labeler that is right four times in five
    settle what the data leave open.
    """
    n_labelers = len(LABELERS)
    posterior = {v: (1 + sum(x > 0 for x in v)) / (2 + sum(x != 0 for x in v)) for v in counts}
    reliability: list[tuple[dict[int, float], dict[int, float]]] = []
    for _ in range(rounds):
        true = sum(n * posterior[v] for v, n in counts.items())
        prior = (true + 2) / (sum(counts.values()) + 4)
        reliability = []
        for j in range(n_labelers):
            yes, no = {1: 8.0, 0: 2.0, -1: 2.0}, {1: 2.0, 0: 2.0, -1: 8.0}
            for v, n in counts.items():
                yes[v[j]] += n * posterior[v]
                no[v[j]] += n * (1 - posterior[v])
            reliability.append(({k: x / sum(yes.values()) for k, x in yes.items()}, {k: x / sum(no.values()) for k, x in no.items()}))
        for v in counts:
            log_odds = math.log(prior / (1 - prior)) + sum(math.log(reliability[j][0][v[j]] / reliability[j][1][v[j]]) for j in range(n_labelers))
            posterior[v] = 1 / (1 + math.exp(-max(-30.0, min(30.0, log_odds))))
    return posterior, reliability


def fit_classifier(counts: dict[tuple[int, ...], int], posterior: dict[tuple[int, ...], float], steps: int = 400) -> list[float]:
    """Logistic weights of the votes, by gradient descent on the posteriors, patterns weighted by the root of their count."""
    w = [0.0] * (1 + 2 * len(LABELERS))
    rows = [([1.0] + [float(x == s) for x in v for s in (1, -1)], posterior[v], math.sqrt(n)) for v, n in counts.items()]
    total = sum(r[2] for r in rows) or 1.0
    for _ in range(steps):
        gradient = [0.001 * x for x in w]
        for x, target, weight in rows:
            z = max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x, strict=True))))
            error = (1 / (1 + math.exp(-z)) - target) * weight / total
            for i, b in enumerate(x):
                gradient[i] += error * b
        w = [a - 1.0 * g for a, g in zip(w, gradient, strict=True)]
    return w


def fit(found: DataFrame) -> SpanModel:
    """found: a table with the column candidates."""
    names = [f"v{i}" for i in range(len(LABELERS))]
    each = found.select(F.explode("candidates").alias("c")).groupBy("c.kind", *[f"c.{v}" for v in names]).agg(F.count(F.lit(1)).alias("n"))
    by_kind: dict[int, dict[tuple[int, ...], int]] = {}
    for r in each.collect():  # at most kinds x 3^labelers rows
        by_kind.setdefault(r["kind"], {})[tuple(r[v] for v in names)] = r["n"]
    model = SpanModel()
    for kind, counts in sorted(by_kind.items()):
        posterior, model.reliability[kind] = fit_em(counts)
        model.weights[kind] = fit_classifier(counts, posterior)
    return model


def accepted(found: Column, model: SpanModel) -> Column:
    """Base spans and added ones, in order of kind and start: array of (kind, start, end)."""
    stay = F.filter(found, lambda c: c["base"] | (model.score(c) >= ADD_AT))
    return F.array_sort(F.transform(stay, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))


def span_text(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), candidates(text).alias("candidates")), "candidates")
    model = fit(found)
    base = F.array_sort(F.transform(F.filter("candidates", lambda c: c["base"]), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))

    def count(kind: int) -> Column:
        return F.size(F.filter("candidates", lambda c: c["base"] & (c["kind"] == kind))).cast("long")

    n = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *n, F.sha2(F.encode(span_text(base), "UTF-8"), 256).alias("base_sha256"), span_text(accepted(F.col("candidates"), model)).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; spans that overlap are one, of the first one's kind."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def piece(t: Column, start: Column, end: Column) -> Column:
        first, last = F.floor(start / CHUNK).cast("int"), F.floor(end / CHUNK).cast("int")
        return F.substring(F.array_join(F.slice(t["chunks"], first + 1, last - first + 1), ""), start % CHUNK + 1, end - start)

    def shown(t: Column) -> Column:
        heads = F.filter(F.zip_with(t["order"], F.slice(t["ended"], F.lit(1), F.size(t["order"])), lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda x: x["s"]["start"] >= x["e"])
        told = F.transform(heads, lambda x: F.concat(piece(t, x["e"], x["s"]["start"]), F.get(names, x["s"]["kind"])))
        return F.concat(F.array_join(told, ""), piece(t, F.element_at(t["ended"], -1), t["n"]))

    def ended(o: Column) -> Column:
        """Before each span, and at last, where all spans so far have ended."""
        until = bound(F.transform(o, lambda s: s["end"]), lambda e: running(e, lambda p, q: F.greatest(p, q)))
        return F.struct(o.alias("order"), F.concat(F.array(F.lit(0)), until).alias("ended"), chunks.alias("chunks"), F.length(text).alias("n"))

    return F.when(F.size(spans) > 0, bound(bound(order, ended), shown)).otherwise(text)


def mask_documents(docs: DataFrame) -> DataFrame:
    """The documents with all their columns, personal data in text masked."""
    text = F.coalesce(F.col("text"), F.lit(""))
    model = fit(docs.select(candidates(text).alias("candidates")))
    spans = accepted(candidates(text), model)
    held = docs.withColumn("__spans", spans)
    out = held.withColumn("text", F.when(F.size("__spans") > 0, masked(text, F.col("__spans"))).otherwise(F.col("text"))).drop("__spans")
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
