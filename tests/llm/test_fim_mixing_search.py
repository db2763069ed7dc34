"""Fill-in-the-middle, mixing and lexical search against plain versions: nulls, repeats, ties, empty and very long texts."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, source string"
CLASH = {"n": 1, "form": "x", "size": 2, "name": "y", "key": "z", "score": 3, "rank": 4, "h": 5}
EDGE = [None, "", " \t\n", "one", "one  two\tthree", "<P> a b c", "a <M>", "x" * 5000, "ünïcödé ß 日本 \x1c\x85 y", "a<S", "< S> b", "nul \x00 here", "a b", "a b"]


def table(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({k: F.lit(v) for k, v in CLASH.items()})


def long_text(n, seed=1):
    r = random.Random(seed)
    return " ".join(f"Wort{r.randrange(5000)}é" for _ in range(n))


# -- fill in the middle


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, c, d = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    low, high = sorted((a % (n + 1), b % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 50:
        return n, "plain", None, None, text
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if d % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_rows():
    r = random.Random(3)
    texts = EDGE + [" ".join(r.choice(["ab", "c\n", "é", "<", "<S", "P>", "日 "]) for _ in range(r.randrange(40))) for _ in range(150)]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    return rows + [(None, "no id here at all", "s"), (None, "other", "s"), (3, "again three", "s"), (3, "again three", "s"), (-7, "a negative id " * 9, "s"), (10**6, long_text(120_000), "s")]


def test_op11_equals_a_plain_version(spark):
    from gleaner.llm.fill_in_middle import fill_in_middle, fill_in_middle_digests

    rows = fim_rows()
    want = Counter((d, *plain_fim(d, t)) for d, t, _ in rows)
    assert {k[2] for k in want} == {"plain", "spm", "psm"}
    assert Counter(map(tuple, fill_in_middle(table(spark, rows).repartition(3)).collect())) == want
    sha = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    told = Counter(map(tuple, fill_in_middle_digests(table(spark, rows)).collect()))
    assert told == Counter((d, *(p := plain_fim(d, t))[:4], sha(p[4]), sha(t)) for d, t, _ in rows)


def test_op11_bounds_shares_and_empty_tables(spark):
    from gleaner.llm.fill_in_middle import fill_in_middle

    df = table(spark, [(i, f"w{i} x y z", "s") for i in range(400)])
    assert fill_in_middle(df.limit(0)).collect() == []
    assert {x.form for x in fill_in_middle(df, percent=0).collect()} == {"plain"}
    assert {x.form for x in fill_in_middle(df, percent=100, spm_percent=0).collect()} == {"psm"}
    other = {x.doc_id: x.output for x in fill_in_middle(df, seed=7).collect()}
    assert sum(other[x.doc_id] != x.output for x in fill_in_middle(df).collect()) > 100
    raw = spark.sql("select 1L doc_id, cast(X'6120FF2062' as string) text")
    assert fill_in_middle(raw, percent=0).first().output == "a � b"


# -- mixing


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_targets(sizes, weights, most):
    """sizes: source -> words. Shares by weight; what is above the cap is shared again until none is."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest, unit = total - sum(most * sizes[s] for s in capped), sum(w[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else w[s] * rest / unit for s in order}
        if not (above := {s for s in order if s not in capped and target[s] > most * sizes[s]}):
            return target
        capped |= above


def mixed_rows(seed=0):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.randrange(60)), r.choice(["b", "a", "Z", None, "ß", "", "b"])) for i in range(600)]
    rows += [(1000 + i, "x " * 9, "tiny") for i in range(2)] + [(2000, None, "none"), (2001, " ", "none"), (None, "no id", "a"), (None, "no id either", "b"), (5, "a b c", "b"), (5, "a b c", "b")]
    return [*rows, (3000, long_text(200_000), "a")]


@pytest.mark.parametrize("ranges", [50_000, 20])
def test_op12_takes_each_budget_exactly(spark, ranges):
    from gleaner.llm import mixing

    rows = mixed_rows()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = plain_targets(sizes, (1, 2, 3), 3)
    assert sum(want[s] == 3 * sizes[s] > 0 for s in want) >= 1
    got = mixing.mix_plan(table(spark, rows).repartition(4), range_rows=ranges).collect()
    assert Counter((x.doc_id, x.source, x.size, x.source_size) for x in got) == Counter((d, s, len(words(t)), sizes[s]) for d, t, s in rows)
    assert all(math.isclose(x.target, want[x.source], rel_tol=1e-12, abs_tol=1e-9) for x in got) and all(0 <= x.taken <= 3 * x.size for x in got)
    for s, t in want.items():
        of = [x for x in got if x.source == s]
        assert sum(x.taken for x in of) == math.floor(t + 0.5)
        # in order of the keys: whole once more, then at most one cut, then not
        key = lambda x: (hashlib.sha256(f"42:{'' if x.doc_id is None else x.doc_id}".encode()).hexdigest(), x.size)
        full = math.floor(t + 0.5) // sizes[s] if sizes[s] else 0
        more = [x.taken - full * x.size for x in sorted(of, key=key) if x.size]
        sizes_in_order = [x.size for x in sorted(of, key=key) if x.size]
        upto = [i for i, (m, z) in enumerate(zip(more, sizes_in_order, strict=True)) if m < z]
        assert not upto or all(m == 0 for m in more[upto[0] + 1 :])
    again = mixing.mix_plan(table(spark, rows).repartition(7), range_rows=ranges).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_op12_many_sources_are_numbered_by_ranges(spark):
    from gleaner.llm import mixing

    rows = [(i, "a b " * (1 + i % 5), f"s{i % 97}") for i in range(500)]
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want = plain_targets(sizes, (1, 2, 3), 3)
    assert all(math.isclose(x.target, want[x.source], rel_tol=1e-12) for x in mixing.mix_plan(table(spark, rows), range_rows=10).collect())


def test_op12_texts_and_empty_tables(spark):
    from gleaner.llm.mixing import mix_plan, mixed_texts

    empty = table(spark, [(1, "a", "s")]).limit(0)
    assert mix_plan(empty).collect() == [] and mixed_texts(empty).collect() == []
    assert [x.taken for x in mix_plan(table(spark, [(1, None, "s"), (2, "", None)])).collect()] == [0, 0]
    rows = [(i, f" p{i}\tq  r{i} \n", ("a", "b", "c")[i % 3]) for i in range(60)] + [(99, "one two three four five", "d")]
    docs = table(spark, rows)
    plan = {x.doc_id: x for x in mix_plan(docs, weights=(1, 7)).collect()}
    told = Counter()
    for x in mixed_texts(docs, weights=(1, 7)).collect():
        source = dict((d, t) for d, t, _ in rows)[x.doc_id]
        assert source.startswith(x.text) and x.rank == 4
        told[x.doc_id] += len(words(x.text))
    assert told == Counter({d: x.taken for d, x in plan.items() if x.taken})
    assert any(x.taken > x.size for x in plan.values()) and any(0 < x.taken % x.size for x in plan.values())


# -- lexical search


def terms(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def plain_search(docs, items, k=10):
    """docs, items: (id, text). Set of (item_id, rank, doc_id, score)."""
    bags = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, wanted in asked.items():
        scored = []
        for d, b in bags:
            m = 10 + (90 * sum(b.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 8 * m)) for t in wanted if b[t])
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return Counter(out)


def search_tables():
    r = random.Random(8)
    word = lambda: f"{r.choice(['K', 'k', 'ß', 'É', 'é', 'x'])}{min(int(r.paretovariate(0.7)), 400)}"
    docs = [(i, r.choice([" ", "-", "\x00", "_ "]).join(word() for _ in range(r.randrange(1, 60)))) for i in range(400)]
    docs += [(1000 + i, "same text of many copies k1 k2") for i in range(60)]  # equal scores, by doc_id
    docs += [(None, "k1 k3 k3"), (None, None), (2000, ""), (2001, "... --- "), (7, "a repeated id k5"), (7, "a repeated id k5"), (-4, "k2 k2 k2"), (3000, " ".join(word() for _ in range(90_000)))]
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 25)))) for i in range(30)]
    items += [(100, "same copies"), (101, None), (102, ""), (103, "unheardof"), (None, "k1 k3"), (104, "k1"), (104, "k1"), (105, "k2"), (105, "many")]
    return docs, items


@pytest.mark.parametrize(("shard", "postings", "block"), [(1 << 15, 1 << 21, 1 << 18), (50, 1 << 21, 1 << 18), (1 << 15, 300, 20)])
def test_op13_equals_a_plain_version(spark, shard, postings, block):
    from gleaner.llm import lexical_search as L

    docs, items = search_tables()
    df = table(spark, [(d, t, "s") for d, t in docs]).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "term": F.lit("x")})
    got = Counter(map(tuple, L.search(df, asked, shard_docs=shard, shard_postings=postings, block_terms=block).collect()))
    assert got == plain_search(docs, items)


def test_op13_max_score_prunes_and_loses_nothing():
    from gleaner.llm.lexical_search import max_score

    rng = np.random.default_rng(1)
    for size in (5, 40, 3000):
        lists = []
        for b in (9, 30, 500, 700, 4000):
            places = np.sort(rng.choice(size, rng.integers(1, size + 1), replace=False)).astype(np.int32)
            each = rng.integers(1, b + 1, len(places))
            lists.append((int(each.max()), places, each))
        whole = np.zeros(size, np.int64)
        for _, p, e in lists:
            whole[p] += e
        best = sorted(whole[whole > 0], reverse=True)[:10]
        places, scores = max_score(lists, size, 10, 1)
        assert (whole[places] == scores).all() and sorted(scores, reverse=True)[:10] == best
        tenth = best[-1] if len(best) == 10 else 1
        assert set(np.flatnonzero(whole >= tenth)) <= set(places)  # ties at the end too
        assert len(max_score(lists, size, 10, int(whole.max()) + 1)[0]) == 0


def test_op13_empty_tables(spark):
    from gleaner.llm.lexical_search import search

    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(docs.limit(0), items).collect() == [] and search(docs, items.limit(0)).collect() == []
    # one document that holds every term: each weighs floor(1000 ln(4/3))
    assert [tuple(x) for x in search(docs, items).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 8 * 100)))]
