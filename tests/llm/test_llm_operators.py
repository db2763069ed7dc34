"""Each operator against a brute-force version, on small tables with nulls, ties, repeats, empty and long texts."""

import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, texts, **more):
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit("clash"), "n": F.lit(1), "group": F.lit("x"), **more})


def words(n, seed, vocabulary=300):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


EDGE = [None, "", " \t\n", "one", "one  two\tthree", "One two three", "x" * 5000, "ünïcödé ß 日本 \x1c\x85 y", "a  b", "a b", "a b"]


@pytest.fixture(scope="module")
def repeated(spark):
    base = [words(60, k) for k in range(8)]
    texts = list(EDGE)
    for k, b in enumerate(base):
        texts.append(" ".join(b))
        texts.append("\n".join(b))  # the same words
        for j in range(3):
            c = list(b)
            c[(7 * j + k) % 60] = "changed"
            texts.append(" ".join(c))
        texts.append(" ".join(words(30, 100 + k) + b[10:35] + words(10, 200 + k)))
    texts += ["", " ".join(words(400, 9) * 3)]
    return texts


def test_op1_removes_what_starts_earlier(spark, repeated):
    from gleaner.llm.substring_dedup import remove_repeats

    split = [(t or "").encode("utf-8").split() for t in repeated]
    first = {}
    for d, w in enumerate(split):
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    got = {r.doc_id: r for r in remove_repeats(table(spark, repeated), with_text=True).collect()}
    assert len(got) == len(repeated)
    for d, w in enumerate(split):
        gone = {i + k for i in range(len(w) - 12) if first[tuple(w[i : i + 13])] < d for k in range(13)}
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    assert remove_repeats(table(spark, [])).count() == 0


def test_op1_a_passage_that_a_text_repeats_goes_everywhere(spark):
    from gleaner.llm import substring_dedup as S

    passage = words(40, 5)
    texts = [" ".join(passage[:30] + words(20, 6)), " ".join(passage + words(20, 7) + passage + words(20, 8) + passage), " ".join(words(20, 9))]
    got = {r.doc_id: r.n_removed for r in S.remove_repeats(table(spark, texts)).collect()}
    assert got == {0: 0, 1: 90, 2: 0}


def test_op1_word_hashes():
    from gleaner.llm import substring_dedup as S

    texts = ["a b  c", "", None, " \t\x0bx\x0c y\r\n", "é ü 日本 a", "x" * 300 + " b " + "x" * 300, "a" * 256 + " " + "a" * 257, " ".join(f"w{i % 99_991}" for i in range(400_000)) + " " + "q" * 999 + " b", "z " * 1_500_000, "end a"]
    h, sizes = S.word_hashes(texts)
    every = [w for t in texts for w in S.words_of(t)]
    assert sizes.tolist() == [len(S.words_of(t)) for t in texts] and len(h) == len(every)
    found = dict(zip(every, h.tolist()))
    assert all(found[w] == x for w, x in zip(every, h.tolist())) and len({*found.values()}) == len(found)


def test_op1_batches_one_at_a_time_equal_one_go(spark, repeated):
    from gleaner.llm import substring_dedup as S

    texts = [*repeated, *[" ".join(words(20, 999) + words(15, 700 + k)) for k in range(120)]]  # a passage that very many share
    df, cuts = table(spark, texts), [-1, 9, 20, 31, 60, len(texts)]
    whole = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.remove_repeats(df).collect()}
    before, share = S.MAX_RUNS, S.HOT_SHARE
    S.MAX_RUNS, S.HOT_SHARE = 2, 0.0  # runs are merged twice
    index, got = S.FingerprintIndex(spark), {}
    try:
        for low, high in zip(cuts, cuts[1:]):
            age = index.add(df.where((F.col("doc_id") > low) & (F.col("doc_id") <= high)))
            got |= {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in index.clean([age]).collect()}
            assert len(index.runs) <= 2
        assert got == whole
        again = index.add(df.where("doc_id < 0"))  # an empty batch on a kept index
        assert index.clean([again]).count() == 0
    finally:
        S.MAX_RUNS, S.HOT_SHARE = before, share
        index.clear()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("gleaner_")]


def test_op2_leaves_are_near_equal_and_gapless(spark, repeated):
    from gleaner.llm.sharding import shard_documents

    texts = [*repeated, *["same" * 20] * 300]
    rows = shard_documents(table(spark, texts), leaves=8).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    sizes = {}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        sizes.setdefault(r.shard, []).append(r)
    assert sorted(sizes) == list(range(8))
    for held in sizes.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    assert max(abs(sum(r.size for r in h) - total / 8) for h in sizes.values()) <= 2 * largest
    assert shard_documents(table(spark, []), leaves=8).count() == 0
    assert {r.shard for r in shard_documents(table(spark, ["a", "b"]), target_bytes=2).collect()} == {0, 1}


def test_op2_splits_along_the_widest_dimension(spark, tmp_path):
    from gleaner.llm import sharding

    r = random.Random(7)
    # of doc_id a node has a part already; lengths differ by order of magnitude
    texts = ["x" * int(10 ** r.uniform(0, 3)) for _ in range(800)] + [None, "", "x" * 20_000]
    df = table(spark, texts)
    rows = {x.doc_id: x for x in sharding.shard_documents(df, leaves=4).collect()}
    # brute force: the first cut is the weighted median of doc_id, the next ones that of the widest of the rest
    size = {d: len(t or "") + 1 for d, t in enumerate(texts)}
    left = {d for d in rows if rows[d].shard < 2}
    cut, total, so_far = max(left), sum(size.values()), 0
    assert left == set(range(cut + 1))
    assert abs(sum(size[d] for d in left) - total / 2) <= max(size.values())
    for half in (left, set(rows) - left):
        one = {d for d in half if rows[d].shard == min(rows[x].shard for x in half)}
        assert abs(sum(size[d] for d in one) - sum(size[d] for d in half) / 2) <= max(size[d] for d in half) / 2 + 1
        by_source = all({rows[x].shard for x in half if x % 3 == d} for d in range(3))
        assert by_source
    sharding.write_shards(df, str(tmp_path / "out"), leaves=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(x.doc_id, x.shard) for x in back.select("doc_id", "shard").collect()} == {(d, rows[d].shard) for d in rows} and back.count() == len(texts)


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
        return 16 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def test_op3_base_spans_stay(spark):
    from gleaner.llm.pii import find_personal_data, mask_documents

    r = random.Random(5)
    parts = ["a.b@c.de", "x@y", "@", "_z@q.org", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "4111111111111112", "+1 (269) 555-3296", "+49 30 12", "+", "555-123-4567", "é", "😀", " ", "\n", ".", "tel: ", "7"]
    texts = [*EDGE, "1 " * 20000, "a" * 20000 + "@b.c", *["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(300)]]
    for row in find_personal_data(table(spark, texts)).collect():
        t = texts[row.doc_id] or ""
        base = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t) if valid(k, m.group())]
        shown = [f"{k}:{a}:{b}" for k, a, b in base]
        assert row.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest(), t
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == x for k, _, _ in base) for x in PATTERNS]
        assert {*shown} <= {*row.spans.split(",")} | {""} if shown else True
    masked = {r.doc_id: r for r in mask_documents(table(spark, ["call +1 (269) 555-3296 or a.b@c.de", "clean text", None])).collect()}
    assert masked[0].text == "call <PHONE> or <EMAIL>" and masked[1].text == "clean text" and masked[2].text is None and masked[0].key == "clash"
    assert find_personal_data(table(spark, [])).count() == 0


def test_op3_is_linear_in_matches(spark):
    from gleaner.llm.pii import find_personal_data, mask_documents

    texts = ["1a" * 500_000, "1." * 500_000, "+1 2" * 250_000, "555-123-4567 " * 80_000, "a@b.co " * 140_000]
    df = table(spark, texts)
    began = time.perf_counter()
    rows = {r.doc_id: r for r in find_personal_data(df).collect()}
    assert [rows[i].n_ip for i in range(5)] == [0, 125_000, 0, 0, 0] and rows[4].n_email == 140_000
    shown = {r.doc_id: r.text for r in mask_documents(df).collect()}
    assert shown[0] == texts[0] and shown[1] == "<IP>." * 125_000 and shown[4] == "<EMAIL> " * 140_000
    assert time.perf_counter() - began < 150  # 5 MB, searched twice; squares of the matches would take hours


def plain_em(counts, rounds):
    """Expectation-maximisation over single candidates instead of vote patterns."""
    votes = np.array([v for v, n in counts.items() for _ in range(n)])
    p = np.array([(1 + (x > 0).sum()) / (2 + (x != 0).sum()) for x in votes])
    for _ in range(rounds):
        prior = (p.sum() + 2) / (len(p) + 4)
        yes = {s: (votes == s).T @ p + (8 if s == 1 else 2) for s in (1, 0, -1)}
        no = {s: (votes == s).T @ (1 - p) + (8 if s == -1 else 2) for s in (1, 0, -1)}
        yes_all, no_all = sum(yes.values()), sum(no.values())
        odds = np.log(prior / (1 - prior))
        for j in range(votes.shape[1]):
            odds = odds + np.array([np.log(yes[s][j] / yes_all[j] * no_all[j] / no[s][j]) for s in votes[:, j]])
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return {tuple(v): x for v, x in zip(votes.tolist(), p)}


def test_op3_em_and_classifier_equal_plain_versions():
    from gleaner.llm import pii

    r = random.Random(3)
    truth = [r.random() < 0.4 for _ in range(500)]
    right = (0.95, 0.8, 0.7, 0.6, 0.9)
    votes = [tuple(0 if r.random() < 0.3 else (1 if t == (r.random() < q) else -1) for q in right) for t in truth]
    counts = {v: votes.count(v) for v in set(votes)}
    posterior, reliability = pii.fit_em(counts, 20)
    want = plain_em(counts, 20)
    assert all(abs(posterior[v] - want[v]) < 1e-9 for v in counts)
    assert sum((posterior[v] > 0.5) == t for v, t in zip(votes, truth)) / 500 > 0.9
    assert reliability[0][0][1] > reliability[3][0][1]  # the better labeler is found out
    w = np.array(pii.fit_classifier(counts, posterior, 400))
    x = np.array([[1.0] + [float(a == s) for a in v for s in (1, -1)] for v in counts])
    y, weight = np.array([posterior[v] for v in counts]), np.sqrt([counts[v] for v in counts])
    plain = np.zeros(x.shape[1])
    for _ in range(400):
        plain -= 0.001 * plain + x.T @ ((1 / (1 + np.exp(-np.clip(x @ plain, -30, 30))) - y) * weight / weight.sum())
    assert np.abs(w - plain).max() < 1e-9
    assert sum(((x[i] @ w > 0) == (y[i] > 0.5)) * counts[v] for i, v in enumerate(counts)) / 500 > 0.95


def test_op4_packs_exact_tokens_without_gaps(spark, repeated):
    from tokenizers import Tokenizer

    from gleaner.llm.packing import best_fit_plan, pack_documents

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*repeated, "<|endoftext|>x", "long " * 5000, " lead", "tail ", "a\n\n b"]
    rows = pack_documents(table(spark, texts), path, with_ids=True).collect()
    library, by_sequence, by_doc = Tokenizer.from_file(path), {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for d, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        pieces = sorted(by_doc[d], key=lambda r: r.piece)
        assert [i for p in pieces for i in p.ids] == ids and [p.piece for p in pieces] == list(range(len(pieces)))
        assert all(p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in pieces)
        assert len(pieces) == -(-len(ids) // 2048) and all(p.length == 2048 for p in pieces[1:])
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    # the plan equals placing pieces one by one, longest first, each in the smallest gap that holds it
    r = random.Random(2)
    lengths = sorted((r.randrange(1, 101) for _ in range(500)), reverse=True)
    gaps = []
    for x in lengths:
        fit = min((g for g in gaps if g >= x), default=None)
        if fit is None:
            gaps.append(100 - x)
        else:
            gaps[gaps.index(fit)] -= x
    plan = best_fit_plan({x: lengths.count(x) for x in set(lengths)}, 100)
    ends = {}
    for k, (x, rank, first, each, _) in enumerate(plan):
        last = plan[k + 1][1] if k + 1 < len(plan) and plan[k + 1][0] == x else lengths.count(x)
        for i in range(last - rank):
            ends[first + i // each] = ends.get(first + i // each, 0) + x
    assert max(ends.values()) <= 100 and len(ends) == len(gaps)
    assert pack_documents(table(spark, []), path).count() == 0


def test_op5_tells_languages_of_held_out_texts(spark):
    from gleaner.llm.language_id import identify_languages, keep_identified

    sounds = {"xx": "ka ro mi tu sen lap", "yy": "œuf älp ñor ßet güm", "zz": "qwi zzo xyl vvu jaq"}
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(sounds[k].split()) + r.choice(sounds[k].split()) for _ in range(20)), k) for i, k in enumerate(sorted(sounds) * 80)]
    rows += [(900, None, "xx"), (901, "123 ... 456", "xx"), (902, "", None), (903, "karo mitu senlap" * 2000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("cells", F.lit(0))
    got = {x.doc_id: x for x in identify_languages(df).collect()}
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= got[d].score <= 1 for d, _, _ in rows)
    held = [(d, k) for d, _, k in rows[:240] if got[d].held_out]
    assert sum(got[d].lang_pred == k for d, k in held) / len(held) > 0.95
    assert [got[d].lang_pred for d in (900, 901, 902, 903)] == ["und", "und", "und", "xx"]
    assert {x.doc_id for x in keep_identified(df).collect()} & {900, 901, 902} == set()
    assert identify_languages(df.where("doc_id < 0")).count() == 0
    assert {x.lang_pred for x in identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_op6_rules_win_and_the_model_judges_the_rest(spark):
    from gleaner.llm.url_filter import judge_urls

    r = random.Random(4)
    urls = ["http://WWW.Example.com/en/1", "http://a.example.com/en/x", "https://example.com/fr", "http://x.net/es/?q", "http://x.net", "http://net/es/", "ftp://com", "nonsense", None, "", "http://", "http://u.com/a?x#y"]
    want = ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, "net/es/", None, None, None, None, None, "com/"]
    urls += [f"http://good{r.choice('abc')}.com/page/{r.randrange(99)}" for _ in range(200)] + [f"http://casino-bad{r.choice('xyz')}.net/es/win-{r.randrange(99)}" for _ in range(200)]
    urls += ["http://gooda.org/page/5", "http://casino-badx.org/es/win-7"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {x.page_id: x for x in judge_urls(df).collect()}
    assert [got[i].rule for i in range(12)] == want and len(got) == len(urls)
    assert [got[i].verdict for i in (0, 1, 2, 3)] == ["allow", "block", "allow", "block"]
    # nothing to read: the closing sign alone is judged, by the method
    assert len({got[i].verdict for i in (7, 8, 9, 10)}) == 1 and len({got[i].score for i in (7, 8, 9, 10)}) == 1 and got[7].score is not None
    assert (got[0].host, got[0].path, got[11].path, got[8].host, got[4].path) == ("www.example.com", "/en/1", "/a", "", "")
    assert (got[len(urls) - 2].verdict, got[len(urls) - 1].verdict) == ("allow", "block")
    assert judge_urls(df.where("page_id < 0")).count() == 0
    assert {x.verdict for x in judge_urls(df.where("page_id = 4")).collect()} == {"allow"}


def test_op6_scores_equal_a_plain_markov_model(spark):
    from gleaner.llm import url_filter as U

    r = random.Random(6)
    rows = [("allow", f"good{r.choice('abc')}.com/page/{r.randrange(99)}") for _ in range(60)] + [("block", f"win-bad{r.choice('xyz')}.net/es/{r.choice(['', 'A', 'ñ?'])}") for _ in range(40)]
    codes = lambda a: [0] * U.ORDER + [U.SIGNS.find("0" if c.isascii() and c.isdigit() else c if c in U.SIGNS else "_") + 1 for c in "".join(c.lower() if c.isascii() else c for c in a)] + [0]
    seen = {v: {} for v, _ in rows}
    for v, a in rows:
        c = codes(a)
        for i in range(U.ORDER, len(c)):
            for k in range(U.ORDER + 1):
                seen[v].setdefault(tuple(c[i - k : i]), {}).setdefault(c[i], 0)
                seen[v][tuple(c[i - k : i])][c[i]] += 1

    def chance(model, context, sign):
        after = model.get(context, {})
        if not context:
            return (after.get(sign, 0) + 1) / (sum(after.values()) + U.ALPHABET)
        shorter = chance(model, context[1:], sign)
        return (after.get(sign, 0) + len(after) * shorter) / (sum(after.values()) + len(after)) if after else shorter

    ruled = spark.createDataFrame(rows, "verdict string, address string")
    asked = [a for _, a in rows[::7]] + ["", "gooda.org/page/5", "www.nobody.example/%20/Q", "x" * 3000]
    got = {x.address: x.score for x in U.scored(spark.createDataFrame([(a,) for a in asked], "address string"), U.ratio_table(ruled)).collect()}
    for a in asked:
        c = codes(a)
        each = [math.log(chance(seen["allow"], tuple(c[i - U.ORDER : i]), c[i])) - math.log(chance(seen["block"], tuple(c[i - U.ORDER : i]), c[i])) for i in range(U.ORDER, len(c))]
        assert got[a] == pytest.approx(sum(each) / len(each), abs=1e-9)


def test_op7_finds_neighbours(spark):
    from gleaner.llm.ann import search_every

    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    x = (centres[rng.integers(0, 20, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[:900] = x[0]  # one very common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0, None] * 8), (3004, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("code", F.lit("clash"))
    got = {}
    for r in search_every(df).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 3000, 100))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(abs(d[v] - s) < 1e-12 for _, v, s in found)
        hit += len({v for _, v, _ in found} & {*best.tolist()})
    assert hit / (10 * len(got)) >= 0.9
    few = search_every(df.where("vec_id in (0, 5, 3001)")).collect()
    assert [(r.query_id, r.vec_id) for r in few] == [(0, 5)]
    assert search_every(df.where("vec_id < 0")).count() == 0


@pytest.mark.parametrize("clusters", [0, 300])
def test_op7_visits_as_many_lists_as_the_recall_takes(clusters):
    from gleaner.llm import ann

    rng = np.random.default_rng(4)
    x = rng.normal(size=(30_000, 32))
    if clusters:
        x = 4 * rng.normal(size=(clusters, 32))[rng.integers(0, clusters, 30_000)] + x
    x = x.astype(np.float32)
    sample, unseen = x[:8000], np.arange(8000) % ann.HELD_OUT == 0
    index = ann.Index(ann.kmeans(sample[~unseen], 200, 12, 1), [], np.zeros(1, int))
    probes = ann.measured_probes(index, sample, sample[unseen], 10)
    lists = ann.nearest(x, index.centroids, 1)[0][:, 0]
    asked = x[8000:8100]
    near = np.argsort(((asked[:, None, :].astype(np.float64) - x[None]) ** 2).sum(axis=2), axis=1)[:, 1:11]
    visited = ann.nearest(asked, index.centroids, probes)[0]
    hit = np.mean([np.isin(lists[n], v).mean() for n, v in zip(near, visited, strict=True)])
    assert hit >= 0.95
    assert probes < 200 and (not clusters or probes < 50)  # near vectors that share nothing need most lists


def test_op7_measures_double_vectors_as_they_are(spark):
    from gleaner.llm.ann import search_every

    rows = [(0, [1.0, 1.0]), (1, [1.0, 1.0 + 1e-12]), (2, [1.0, 1.0 - 3e-12])]
    found = search_every(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r.vec_id for r in sorted(found, key=lambda r: r.rank)] == [1, 2]
    assert all(r.score == abs(rows[r.vec_id][1][1] - 1.0) for r in found)


def test_op7_measures_every_row_that_shares_a_code():
    from types import SimpleNamespace

    import pyarrow as pa

    from gleaner.llm import ann

    rng = np.random.default_rng(3)
    index = ann.fit_index(rng.normal(size=(4000, 32)).astype(np.float32), 1)
    x = (rng.normal(size=32) + 1e-3 * rng.normal(size=(3000, 32))).astype(np.float32)  # near copies that the fit hasn't seen
    codes = index.encode(x - index.centroids[0])
    assert len(np.unique(codes, axis=0)) < 100
    vectors = pa.array(x.tolist(), pa.list_(pa.float32()))
    rows = pa.table({"vec_id": pa.array(range(3000), pa.int64()), "vector": vectors, "list": pa.array([0] * 3000, pa.int32()), "code": [c.tobytes() for c in codes]})
    asked = range(5, 3000, 300)
    queries = rows.select(["vec_id", "vector"]).take(pa.array(asked)).append_column("lists", pa.array([[0]] * len(asked), pa.list_(pa.int32())))
    found = ann._search(SimpleNamespace(value=index), 32, 10, ann.RERANK)(queries, rows).to_pandas()
    for q in asked:
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(axis=1))
        d[q] = np.inf
        assert found[found.query_id == q].vec_id.tolist() == np.lexsort((np.arange(3000), d))[:10].tolist()


def plain_components(texts, width):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [len(s) for s in sets], root


def test_op8_components_equal_brute_force(spark, repeated):
    from gleaner.llm import near_dedup as N

    r = random.Random(8)
    base = words(80, 77)
    chain = []
    for _ in range(120):  # a chain: neighbours are linked, distant ones aren't
        base = list(base)
        base[r.randrange(80)] = f"c{r.randrange(10**6)}"
        chain.append(" ".join(base))
    texts = [*repeated, *chain]
    n, want = plain_components(texts, 4)
    got = {x.doc_id: x for x in N.near_duplicates(table(spark, texts), width=4).collect()}
    assert [got[d].component_id for d in range(len(texts))] == want and [got[d].n_shingles for d in range(len(texts))] == n
    assert all(got[d].kept == (got[d].component_id == d) for d in got)
    # large families, block by block
    again = {x.doc_id: x.component_id for x in N.near_duplicates(table(spark, texts), width=4, block=16).collect()}
    assert [again[d] for d in range(len(texts))] == want
    assert N.near_duplicates(table(spark, [])).count() == 0
    kept = N.drop_near_duplicates(table(spark, texts), width=4).collect()
    assert sorted(x.doc_id for x in kept) == [d for d in range(len(texts)) if want[d] == d]


@pytest.mark.parametrize("n", [150, 300, 600])
def test_op8_pairs_below_the_threshold_never_become_rows(spark, monkeypatch, n):
    """Texts of one template share 300 words and have 45 of their own: a similarity of 0.77, so none is linked."""
    from gleaner.llm import near_dedup as N

    base = [f"t{k}" for k in range(300)]
    texts = [" ".join(base + [f"o{i}x{k}" for k in range(45)]) for i in range(n)]
    rows, whole = {}, N.stored

    def counting(df, name="t"):
        out = whole(df, name)
        rows[name] = rows.get(name, 0) + (out.count() if name in ("told", "groups", "open", "rows", "with_sets") else 0)
        return out

    monkeypatch.setattr(N, "stored", counting)
    got = N.near_duplicates(table(spark, texts).repartition(4), width=4).collect()
    assert all(x.kept and x.component_id == x.doc_id for x in got) and len(got) == n
    # each name is stored twice, in the first search and in the one on full sets
    assert rows["told"] <= 40 * n and all(rows[k] <= 2 * 40 * n for k in ("groups", "open", "rows")) and rows["with_sets"] <= 40 * n


def test_op9_keeps_the_smallest_of_equal_texts(spark, repeated):
    from gleaner.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

    texts = [*repeated, *["hot  copy", "hot copy"] * 1500]
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in texts]
    first, n = {}, {}
    for d, t in enumerate(norm):
        first.setdefault(t, d)
        n[t] = n.get(t, 0) + 1
    got = {x.doc_id: x for x in exact_duplicates(table(spark, texts)).collect()}
    for d, t in enumerate(norm):
        assert (got[d].keep_id, got[d].group_size, got[d].kept, got[d].text_sha256) == (first[t], n[t], first[t] == d, hashlib.sha256(t.encode()).hexdigest())
    assert sorted(x.doc_id for x in drop_exact_duplicates(table(spark, texts)).collect()) == sorted(first.values())
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "doc_id long, text string")
    assert sorted((x.doc_id, x.group_size, x.kept) for x in exact_duplicates(twice).collect()) == [(1, 3, False), (1, 3, True), (2, 3, False)]
    assert exact_duplicates(table(spark, [])).count() == 0
    # more rows than one filter serves: several ranges, one filter after the other
    again = {x.doc_id: x for x in exact_duplicates(table(spark, texts), filter_slots=1 << 14).collect()}
    assert again == got


def test_op9_filters_are_alive_one_at_a_time(spark, monkeypatch):
    from gleaner.llm import exact_dedup as X

    made, whole = [], X.mark_repeats

    def one(digests, total):
        assert not any(h._jbroadcast.isValid() for h in made)
        df, held = whole(digests, total)
        made.append(held)
        return df, held

    monkeypatch.setattr(X, "mark_repeats", one)
    rows = [(None if i % 50 == 0 else i, f"t{i % 700}") for i in range(2000)]
    got = X.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), filter_slots=1 << 13).collect()
    assert len(made) == 4 and len(got) == 2000 and sum(x.kept for x in got) >= 700


def test_op10_equals_the_library(spark, repeated):
    from tokenizers import Tokenizer

    from gleaner.llm.bpe import ForcedBoundaryTokenizer, encode_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    r = random.Random(6)
    texts = [*repeated, "don't we'll <|endoftext|>X<|startoftext|> y", *["".join(r.choice("abé'sS  \n\t.É́ ẞİΣ12<|>日ſK\x1c😀") for _ in range(r.randrange(50))) for _ in range(200)]]
    library = Tokenizer.from_file(path)
    for x in encode_documents(table(spark, texts), path, with_ids=True).collect():
        ids = library.encode(texts[x.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert x.ids == ids and x.decoded == decoded and x.n_tokens == len(ids)
        assert x.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and x.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    t = ForcedBoundaryTokenizer(path)
    assert any(len(t.fragments(w.encode() + t.end)) > 1 for w in ("xqzj", "zzxqk", "ßüñ日"))
    assert encode_documents(table(spark, []), path).count() == 0


def test_pipeline_stages_take_effect(spark, repeated, tmp_path):
    import corpus_pipeline as P

    texts = [*[t for t in repeated if t], "call me: +1 (269) 555-3296 or a.b@c.de " + " ".join(words(40, 55))]
    table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names, ids = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == names
        ids.append({r.doc_id for r in docs.collect()})
    lettered = {d for d, t in enumerate(texts) if any(c.isalpha() for c in t)}
    assert ids[0] <= lettered
    norm = {d: re.sub(r"[\x20\x09-\x0D]+", " ", texts[d]) for d in ids[0]}
    assert ids[1] == {min(d for d in norm if norm[d] == t) for t in norm.values()}
    order = sorted(ids[1])
    _, root = plain_components([texts[d] for d in order], 5)
    assert ids[2] == {order[k] for k, r in enumerate(root) if r == k} and ids[3] == ids[2]
    last = {r.doc_id: r.text for r in docs.collect()}
    assert "<PHONE>" in last[len(texts) - 1] and "<EMAIL>" in last[len(texts) - 1]
    packed = P.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == ids[3]
