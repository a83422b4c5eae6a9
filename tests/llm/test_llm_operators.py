"""Each operator against a brute-force version or held-out labels, and on nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
import textwrap
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import catalog, common, components, decontam, langid, license_scan, line_dedup, mixing, near_dedup, quality, sharding, substring_dedup, toxicity

LONG = " ".join(f"w{i}" for i in range(40_000)) + "."
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASH = "shard slot key size bucket node digest component a b u v head ka kb score lang_pred letters c0 runs doc mix_key mix_copies mix_source mark start windows seed place t w lines g s good n_words kept form license_id".split()


def rows():
    prose = [" ".join(f"{x}{i}" for i in range(k, k + 60)) + "." for k, x in ((0, "alpha"), (7, "beta"), (100, "gamma"))]
    texts = [None, "", "   ", "1234 5678", "one", "Hello world again.", *prose, prose[0], prose[0].replace("alpha3", "alphaX"), prose[0] + "\n" + prose[1], LONG, LONG, "a\nb\nc\nd\na\nb\nc\nd", "x | y | z\nx | y | z\nhome", "퟿ ẞ É 漢字 かな", "the " * 200]
    out = [(i, t, None if i % 5 == 0 else "xy"[i % 2], None if i % 4 == 0 else "s" if i % 3 else "r", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[6], out[6], (None, prose[2], "x", "s", 3), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def messy(spark):
    return common.materialise(spark.createDataFrame(rows(), SCHEMA))


@pytest.fixture(scope="module")
def clashing(messy):
    return messy.select("*", *(F.lit("clash").alias(c) for c in CLASH))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def same_rows(a, b):
    assert Counter(map(repr, a.collect())) == Counter(map(repr, b.collect()))


def documents(spark, part=DATA):
    return spark.read.parquet(f"{part}/documents.parquet")


# 1 sharding


def minimax(sizes, shards):
    low, high = max(sizes), sum(sizes)
    while low < high:
        mid, used, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > mid:
                used, at = used + 1, 0
            at += s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(4))
def test_minimax_capacity(spark, seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, [10, 1000, 3, 10**6][seed], [5, 400, 60, 200][seed]).tolist()
    if seed == 3:
        sizes[100] = sum(sizes) // 2
    keys = sorted(rng.integers(0, 1 << [20, 60, 60, 30][seed], len(sizes)).tolist())
    groups = spark.createDataFrame(list(dict(zip(keys, sizes, strict=True)).items()), "key long, size long")
    sizes = list(dict(zip(keys, sizes, strict=True)).values())
    capacity, cuts = sharding.minimax_cuts(groups, 7)
    assert capacity == minimax(sizes, 7)
    total = Counter()
    for k, s in zip(sorted(set(keys)), sizes, strict=True):
        total[sum(k >= c for c in cuts)] += s
    assert max(total.values()) <= capacity and len(cuts) == 6


def test_shards(messy, clashing, none):
    got = sharding.shard_documents(messy, 4).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    text = {r[0]: r[1] for r in rows() if r[0] is not None}
    place = defaultdict(set)
    for r in got:
        if r.doc_id is not None:
            place[text[r.doc_id]].add(r.shard)
            assert r["size"] == len((text[r.doc_id] or "").encode()) + 1
            assert r.text_crc32 == (None if text[r.doc_id] is None else zlib.crc32(text[r.doc_id].encode()))
    assert all(len(p) == 1 for p in place.values())
    same_rows(sharding.shard_documents(clashing, 4), sharding.shard_documents(messy, 4))
    assert sharding.shard_documents(none, 4).count() == 0


# 2 language


def test_language_held_out(spark):
    part = DATA.replace("sf0.001", "sf0.01")
    got = {r.doc_id: r for r in catalog.op2_language(spark, part).collect()}
    lang = {r.doc_id: r.lang for r in documents(spark, part).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == lang[i] for i in held) / len(held) > 0.98


def test_language_edges(spark, messy, clashing, none):
    net = langid.fit(documents(spark))
    got = langid.identify(messy, net, ["doc_id"]).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {0, 1, 2, 3, None}
    assert all(r.score == 0 for r in got if r.lang_pred == "und")
    same_rows(langid.identify(clashing, net, ["doc_id"]), langid.identify(messy, net, ["doc_id"]))
    assert langid.fit(none) is None and langid.identify(none, net, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in langid.identify(messy, None, ["doc_id"]).collect()} == {"und"}
    assert langid.keep_identified(clashing, net, 0.0).columns == clashing.columns


def test_windows_cover_every_byte():
    data = np.arange(1, 251, dtype=np.uint8).repeat(5)
    owner, start, held = langid._windows(np.array([0, 0, 1, 4, 700, len(data)]))
    x = langid._spell(data, start, held)
    for i, (a, b) in enumerate(((0, 0), (0, 1), (1, 4), (4, 700), (700, len(data)))):
        grams = {data[k : k + 4].tobytes() for k in range(a, b - 3)}
        seen = {w[k : k + 4].tobytes() for w, h in zip(x[owner == i], held[owner == i], strict=True) for k in range(h - 3)}
        assert grams <= seen and (owner == i).sum() == (0 if a == b else max(1, -(-(b - a - 3) // (langid.WINDOW - 3))))


# 3 lines


def test_lines(spark, messy, clashing, none):
    got = {r.doc_id: r for r in line_dedup.drop_repeated_lines(messy).collect()}
    assert got[14].text == "a\nb\nc\nd\n" and got[14].n_removed == 4
    assert got[0].text is None and got[1].text == "" and got[12].text == LONG
    same_rows(line_dedup.drop_repeated_lines(clashing).select("doc_id", "text", "n_removed"), line_dedup.drop_repeated_lines(messy).select("doc_id", "text", "n_removed"))
    assert line_dedup.drop_repeated_lines(none).count() == 0
    docs = spark.createDataFrame([(1, "p\nq\nr\ns"), (2, "z\nq\nr\ns\n\nt"), (3, "y\nq\nr"), (4, "x\nx\nx\nx\nx"), (None, "p\nq\nr\ns")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()} == {1: "p\nq\nr\ns", 2: "z\n\nt", 3: "y\nq\nr", 4: "x\nx\nx\n", None: "p\nq\nr\ns"}


def cut_lines(docs, run, long):
    """Brute force: every window against all earlier places."""
    lines = {i: [x for x in t.split("\n") if words(x)] for i, t in docs}
    window = lambda i, n: next((tuple(lines[i][n : n + k]) for k in range(1, run + 1) if (k == run or sum(len(words(x)) for x in lines[i][n : n + k]) >= long) and n + k <= len(lines[i])), None)
    first, out = {}, {}
    for i, _ in sorted(docs):
        gone = set()
        for n in range(len(lines[i])):
            if w := window(i, n):
                d, at = first.setdefault(w, (i, n))
                gone |= set(range(max(n, at + len(w)) if d == i else n, n + len(w))) if (d, at) != (i, n) else set()
        out[i] = [x for n, x in enumerate(lines[i]) if n not in gone]
    return out


def test_lines_are_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = [" ".join(f"w{x}" for x in rng.integers(0, 500, int(n))) for n in rng.choice([1, 3, 9, 14, 40], 40)]
    docs = [(i, "\n".join(pool[x] for x in rng.integers(0, 40 if i % 3 else 4, int(rng.integers(0, 30))))) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for run, long in ((3, 25), (4, 12), (2, 1000)):
        got = {r.doc_id: [x for x in r.text.split("\n") if words(x)] for r in line_dedup.drop_repeated_lines(df, run, long).collect()}
        assert got == cut_lines(docs, run, long)


def test_lines_of_rows_that_share_an_id(spark):
    """Rows of one id with different texts are documents of their own: each row's result has lines of its own text only."""
    shared = "\n".join(f"shared line {i}" for i in range(4))
    texts = ["short a\nshort b", "\n".join(f"line {i} x" for i in range(20)) + "\n" + shared, "second\n" + shared, "third\n" + shared + "\nend", "second\n" + shared]
    docs = spark.createDataFrame([(1, texts[0]), (0, shared), (1, texts[1]), (1, texts[2]), (1, texts[3]), (1, texts[4])], "doc_id long, text string").coalesce(1)
    got = Counter(r.text.rstrip("\n") for r in line_dedup.drop_repeated_lines(docs).collect())
    assert got == Counter([texts[0], shared, "\n".join(f"line {i} x" for i in range(20)), "second", "third\nend", "second"])
    long = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(2, "x\n" + long + "\ny"), (3, long), (4, "a b\n" + long[:-1])], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(docs).collect()} == {2: "x\n" + long + "\ny", 3: "", 4: "a b\n" + long[:-1]}


# 4 passages


def test_passages(spark, messy, clashing, none):
    rng = np.random.default_rng(4)
    text = lambda n: [f"k{x}" for x in rng.integers(0, 10**6, n)]
    passage, texts = text(80), [text(150) for _ in range(6)]
    texts[1] = texts[1][:40] + passage + texts[1][40:]
    texts[3] = passage + texts[3]
    fuzzy = [w if i % 13 else "changed" for i, w in enumerate(passage)]
    texts[5] = texts[5] + fuzzy[:30] + ["added", "words"] + fuzzy[30:]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.other_id): r for r in substring_dedup.shared_passages(docs).collect()}
    assert set(got) == {(3, 1), (5, 1)}
    assert (got[3, 1].start, got[3, 1].end, got[3, 1].other_start, got[3, 1].other_end) == (0, 80, 40, 120)
    assert got[5, 1].end - got[5, 1].start >= 75
    pairs = {(r.doc_id, r.other_id) for r in substring_dedup.shared_passages(messy).collect()}
    assert {(9, 6), (10, 6), (11, 6), (13, 12)} <= pairs and not {0, 1, 2, 3, 4, 5} & {i for p in pairs for i in p}
    same_rows(substring_dedup.shared_passages(clashing), substring_dedup.shared_passages(messy))
    assert substring_dedup.shared_passages(none).count() == 0


def test_passages_with_words_between(spark):
    """Passages of one pair of documents, with other words between that are too many for one passage of 80 %."""
    new = iter(range(10**6))
    text = lambda n: [f"k{next(new) * 7919 % 10**6}" for _ in range(n)]
    layouts = [(60, g, 60) for g in (40, 60, 100, 200, 300)] + [(300, 130, 100), (8, 22, 60)]
    docs, want = [], set()
    for i, (first, gap, second) in enumerate(layouts):
        for k in range(5):
            one, two, a, b = text(first), text(second), 20 * i + 4 * k, 20 * i + 4 * k + 2
            docs += [(a, text(90) + one + text(gap) + two + text(70)), (b, text(110) + one + text(gap + 9) + two + text(40))]
            want |= {(b, at, at + n) for n, at in ((first, 110), (second, 110 + first + gap + 9)) if n >= 50}
    got = substring_dedup.shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string"))
    assert {(r.doc_id, r.start, r.end) for r in got.collect()} == want


def test_passages_of_which_earlier_documents_hold_parts(spark):
    """Of exact passages whose parts occur in earlier documents, each later document after the first that holds it all has the row."""
    new = iter(range(10**6))
    text = lambda n: [f"k{next(new) * 7919 % 10**6}" for _ in range(n)]
    docs, want = [], set()
    for case in range(60):
        p, i = text(60 if case < 20 else 50), 10 * case
        parts = [p[:20], p[20:40], p[40:]] if case < 20 else [p[:39]] if case < 40 else [p[:49], p[1:]]
        docs += [(i + k, text(30) + part + text(30)) for k, part in enumerate(parts)]
        docs += [(i + 4, text(37) + p + text(21)), (i + 5, text(11) + p + text(50))]
        want.add((i + 5, 11, 11 + len(p), i + 4, 37, 37 + len(p)))
    got = substring_dedup.shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")).collect()
    assert {tuple(r)[:6] for r in got} >= want and {r.doc_id % 10 for r in got if r.doc_id < 400} == {5}


def test_fuzzy_passages_of_which_earlier_documents_hold_parts(spark):
    """No earlier document with some of a passage's seeds, and no earlier place in the same one, keeps two from being linked; nor do many others with a part."""
    new = iter(range(10**6))
    text = lambda n: [f"k{next(new) * 7919 % 10**6}" for _ in range(n)]
    docs, want = [], set()
    common = text(20)
    for case in range(40):
        p, i = text(64), 10 * case
        fuzzy = [w if k % 16 != 15 else f"changed{case}" for k, w in enumerate(p)]
        if case % 4 == 1:  # words of one side are missing
            fuzzy = p[:21] + p[23:43] + p[44:]
        parts = [p[:16], p[16:32], p[32:48], p[48:]]
        if case % 4 == 2:  # the parts are in the document itself, ahead and in another order
            docs.append((i + 4, text(30) + parts[3] + text(5) + parts[1] + text(5) + parts[2] + text(9) + parts[0] + text(20) + p + text(21)))
        elif case % 4 == 3:  # a part of both is common
            p, fuzzy = p[:22] + common + p[42:], fuzzy[:22] + common + fuzzy[42:]
            docs += [(i + k, text(30) + part + text(30)) for k, part in enumerate([p[:14], p[14:22] + common, common + p[42:50], p[50:]])]
            docs.append((i + 4, text(37) + p + text(21)))
        else:
            docs += [(i + k, text(30) + part + text(30)) for k, part in enumerate(parts)]
            docs.append((i + 4, text(37) + p + text(21)))
        docs.append((i + 5, text(11) + fuzzy + text(50)))
        want.add((i + 5, i + 4))
    got = substring_dedup.shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")).collect()
    passed = {(r.doc_id, r.other_id) for r in got if r.end - r.start >= 55}
    assert passed == want == {(r.doc_id, r.other_id) for r in got}
    # many with a part, more than one block
    p = text(60)
    docs = [(k, text(30) + p[:20] + text(30)) for k in range(2500)] + [(3000, text(20) + p[:50] + ["other"] + p[51:] + text(8))]
    docs += [(3001, text(40) + p[:25] + ["changed"] + p[26:] + text(30))]
    got = substring_dedup.shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id, r.start, r.end) for r in got} == {(3001, 3000, 40, 100)}


def test_fuzzy_passages_of_many_documents_are_few_rows(spark):
    """Of n documents with a fuzzy passage of which earlier ones hold the parts, all are linked, by a few pairs each and not by all."""
    new, n = iter(range(10**6)), 40
    text = lambda n: [f"k{next(new) * 7919 % 10**6}" for _ in range(n)]
    p = text(96)
    docs = [(k, text(30) + p[k * 16 : k * 16 + 16] + text(30)) for k in range(6)]
    docs += [(10 + k, text(20) + [w if i % 16 != 15 else f"changed{k}" for i, w in enumerate(p)] + text(20)) for k in range(n)]
    got = substring_dedup.shared_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string")).collect()
    part = {i: i for i, _ in docs}
    for r in got:
        a, b = part[r.doc_id], part[r.other_id]
        part = {k: min(a, b) if v in (a, b) else v for k, v in part.items()}
    assert [part[i] for i, _ in docs] == [*range(6), *[10] * n]
    # a seed that only some of them chose, for the words beside it, has a first document of its own
    assert n - 1 <= len({(r.doc_id, r.other_id) for r in got}) < 5 * n


def test_extents_bound_those_of_the_words():
    """extents() against _extend() on words of which a byte is known; what may go on beyond AROUND words has more."""
    rng, around, kmer = np.random.default_rng(11), substring_dedup.AROUND, substring_dedup.KMER
    a = rng.integers(2, 250, (300, 2 * around + kmer)).astype(np.uint8)
    b = np.where(rng.random(a.shape) < rng.random((300, 1)), a, rng.integers(2, 250, a.shape)).astype(np.uint8)
    b[:, around : around + kmer] = a[:, around : around + kmer]
    a[:60, :30], b[40:90, 70:] = 0, 0
    for i, (before, behind, agree) in enumerate(zip(*substring_dedup.extents(a, b), strict=True)):
        x, y = np.where(a[i] > 0, a[i].astype(int), -1), np.where(b[i] > 0, b[i].astype(int), -2)
        sides = [substring_dedup._extend(x[:around][::-1], y[:around][::-1]), substring_dedup._extend(x[around + kmer :], y[around + kmer :])]
        assert all(n in (take, around + 1) for n, (take, _) in zip((before, behind), sides, strict=True))
        assert agree == np.count_nonzero(x[around : around + kmer] == y[around : around + kmer]) + sum(same for _, same in sides)


def test_what_may_hold_a_passage_is_brute_force():
    """likely() against all pairs of rows: equal words at the same distance, or six in a row at another and enough of them near."""
    rng, n = np.random.default_rng(3), 60
    words = rng.integers(2, 250, (n, 2 * substring_dedup.AROUND + substring_dedup.KMER)).astype(np.uint8)
    for i in range(1, n, 2):
        k, at = int(rng.integers(10, 60)), int(rng.integers(0, 40))
        words[i, at : at + k] = words[i - 1, at : at + k]
        if i % 4 == 1:
            words[i, at + 10 :] = np.roll(words[i - 1], -3)[at + 10 :]
    words[5, :30] = words[9, 70:] = 0
    group = np.sort(rng.integers(0, 6, n // 2)).repeat(2)
    open_ = np.concatenate([np.arange(c) < c - 2 for c in np.bincount(group) if c])
    got = {(int(i), int(j)) for p, q in substring_dedup.likely(words, group, open_, 40, lambda i, j: (i + j) % 7 != 0) for i, j in zip(p, q, strict=True)}
    want, g = set(), substring_dedup.KMER
    for i in range(n):
        for j in range(i + 1, n):
            if group[i] == group[j] and open_[i] and (i + j) % 7:
                a, b = words[i], words[j]
                near = sum(any(a[x] == b[y] > 0 for y in range(max(0, x - 16), min(len(b), x + 17))) for x in range(len(a)))
                grams = [{(bytes(w[x : x + g]), x) for x in range(len(w) - g + 1) if w[x : x + g].all() and x != substring_dedup.AROUND} for w in (a, b)]
                if np.count_nonzero((a == b) & (a > 0)) >= 40 or near >= 40 and any(u == v and x != y for u, x in grams[0] for v, y in grams[1]):
                    want.add((i, j))
    assert got == want and len(want) > 10


def test_passages_find_exact_repeats(spark):
    """Every window of PASSAGE words that occurred in a document of smaller id lies in a row of its document, whatever its words are."""
    docs = documents(spark, DATA.replace("sf0.001", "sf0.01"))
    rows, first, size, n = defaultdict(list), {}, substring_dedup.PASSAGE, 0
    for r in substring_dedup.shared_passages(docs).collect():
        rows[r.doc_id].append((r.start, r.end))
    for r in sorted(docs.select("doc_id", "text").collect()):
        w = words(r.text)
        for p in range(len(w) - size + 1):
            if first.setdefault(tuple(w[p : p + size]), r.doc_id) != r.doc_id:
                n += 1
                assert any(a <= p and p + size <= b for a, b in rows[r.doc_id]), (r.doc_id, p)
    assert n > 1000


def test_large_gaps_are_aligned_exactly(monkeypatch):
    """Halving a gap gives the words that agree in the best alignment, as one table does."""
    rng = np.random.default_rng(6)
    for n, m in ((300, 280), (40, 900), (700, 30), (1, 400)):
        a, b = rng.integers(0, 12, n), rng.integers(0, 12, m)
        steps = substring_dedup._path(a, b)
        assert (sum(s[0] for s in steps), sum(s[1] for s in steps)) == (n, m)
        best = substring_dedup._common(a, b)
        assert best == sum(s[2] for s in steps)
        with monkeypatch.context() as m_:
            m_.setattr(substring_dedup, "GAP_CELLS", 10**9)
            assert best == sum(s[2] for s in substring_dedup._path(a, b))


def test_chain_is_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(20):
        x, y = rng.integers(0, 60, 12), rng.integers(0, 60, 12)
        for chain in substring_dedup.chains(x, y):
            assert all(a[0] + 0 <= b[0] and a[1] < b[1] for a, b in zip(chain[:-1], chain[1:], strict=True))
    tree, best = substring_dedup.Fenwick(50), {}
    for i in range(200):
        r, v = int(rng.integers(0, 50)), float(rng.random())
        tree.put(r, v, i)
        best[r] = max(best.get(r, 0), v)
        q = int(rng.integers(1, 51))
        assert tree.top(q)[0] == max((v for k, v in best.items() if k < q), default=-1e18)


# 5 near duplicates


def brute(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates(messy, clashing, none):
    want = brute([(r[0], r[1]) for r in rows() if r[0] is not None], 3, 85)
    got = near_dedup.near_duplicates(messy, 3, 85).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    same_rows(near_dedup.near_duplicates(clashing, 3, 85), near_dedup.near_duplicates(messy, 3, 85))
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.keep_one_of_each(clashing, 3, 85)
    assert kept.columns == clashing.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter({i: 1 for i, (_, c) in want.items() if c == i} | {None: 2})


def test_many_near_copies(spark):
    """A large group of copies of which some are linked to others only, beside the comparison with the group's first."""
    rng = np.random.default_rng(6)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(300):
        w = list(base)
        for j in rng.choice(120, int(rng.integers(0, 7)), replace=False):
            w[j] = f"x{rng.integers(0, 40)}"
        docs.append((i, " ".join(w)))
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    want = brute(docs, 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("block", [128, 7])
def test_links_beside_a_groups_first(spark, monkeypatch, block):
    """Boilerplate that many documents share, with links between some of these only: in blocks beside the group's first."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rng = np.random.default_rng(8)
    base, docs = [f"b{i}" for i in range(100)], []
    for i in range(160):
        w = list(base[: int(rng.integers(70, 100))])
        for j in rng.choice(len(w), int(rng.integers(0, 9)), replace=False):
            w[j] = f"x{rng.integers(0, 12)}"
        docs.append((i, " ".join(w + [f"own{i // 2}" for _ in range(3)])))
    want = brute(docs, 3, 85)
    assert 3 < len({c for _, c in want.values()}) < 160
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df, 3, 85).collect()} == want
    # every member against all others, as if all were of one table
    sets = common.materialise(near_dedup.shingle_sets(df, 3))
    members = df.select(F.lit(1).alias("key"), F.lit(1).alias("ka"), F.col("doc_id").alias("node"), F.col("doc_id").alias("component"))
    each = {i: {tuple(words(t)[j : j + 3]) for j in range(len(words(t)) - 2)} for i, t in docs}
    links = {(i, j) for i in each for j in each if i < j and 100 * len(each[i] & each[j]) >= 85 * len(each[i] | each[j])}
    assert {(r.u, r.v) for r in near_dedup._links_left(members, sets, 85).collect()} == links


def test_components(spark):
    rng = np.random.default_rng(7)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.component for r in got} == {n: find(n) for n in nodes} and len(got) == len(nodes)
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# 6 mixing


def test_mixing(spark, messy, clashing, none):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "a").when(F.col("id") % 1000 == 1, "c").otherwise("b").alias("source"))
    got = Counter(r.source for r in mixing.mix(docs, weights={"a": 1, "b": 1, "c": 2}).collect())
    assert all(abs(got[k] / 20_000 - share) < 0.02 for k, share in (("a", 0.25), ("b", 0.25), ("c", 0.5)))
    once = mixing.mix(messy).collect()
    assert Counter(once) == Counter(mixing.mix(messy).collect())
    assert all(Counter((r.doc_id, r.text, r.mix_replica) for r in once)[r.doc_id, r.text, r.mix_replica] == Counter(map(tuple, rows()))[r[:5]] for r in once)
    assert Counter(r.doc_id for r in mixing.mix(clashing).collect()) == Counter(r.doc_id for r in once)
    assert mixing.mix(none).count() == 0
    assert mixing.mix(docs, weights={"a": 0, "b": 0, "c": 0}).count() == 0


def test_mixing_without_ids(spark):
    """Rows without an id, and rows that share one, draw by their texts: their source has its rate too."""
    docs = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.lit(7)).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") % 4 < 2, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs, weights={"a": 3, "b": 1}).groupBy("source").count().collect()
    assert all(abs(r["count"] / 4000 - {"a": 0.75, "b": 0.25}[r.source]) < 0.04 for r in got) and len(got) == 2
    many = {f"s{i}": float(i) for i in range(3000)}
    assert mixing.mix(docs.withColumn("source", F.concat(F.lit("s"), F.length("text"))), weights=many | {None: 1.0}).count() > 3000


# 7 licences


def test_licenses(spark, messy, clashing, none):
    mit = next(t for i, t in license_scan.KNOWN if i == "MIT")
    texts = [mit, "MIT Licence\n\nCopyright (c) 2020 Somebody & Co.\n\n" + mit.upper().replace(" ", "\n "), mit + " And more.", None, "", "Copyright 2020 X", "Licensed under the apache licence — version 2.0"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert [got[i].license_id for i in range(7)] == ["MIT", "MIT", None, None, None, None, "Apache-2.0"]
    assert got[3].digest is None and got[4].digest is None and got[5].digest is None
    same_rows(license_scan.scan(clashing), license_scan.scan(messy))
    assert license_scan.scan(none).count() == 0
    assert {r.license_id for r in license_scan.scan(docs, known=license_scan.known_licenses(spark).where("false")).collect()} == {None}


def test_license_copies_as_found(spark):
    """Whole copies of licences as files have them: other titles, holders without a year, reserved rights, bullets, wrapped lines."""
    text = {i: t for i, t in reversed(license_scan.KNOWN) if len(t) > 400}
    wrap = lambda t: "\n".join(textwrap.fill(x, 60) for x in t.split("\n"))
    copies = [
        ("MIT", "The MIT License\n\nCopyright Jane Doe\n\n" + wrap(text["MIT"])),
        ("MIT", "Copyright © 2011-2020 The Authors <a@b.example>\nCopyright (c) 2021 Others\n\n" + text["MIT"].upper().replace("LICENSE", "LICENCE")),
        ("BSD-3-Clause", "Copyright (c) 2019, Somebody\nAll rights reserved.\n\n" + wrap(text["BSD-3-Clause"])),
        ("BSD-3-Clause", "Copyright Somebody and Others\n\n" + re.sub(r"(?m)^[0-9]\\. ", " * ", text["BSD-3-Clause"])),
        ("BSD-2-Clause", re.sub(r"(?m)^([0-9])\\. ", r"(\\1) ", text["BSD-2-Clause"])),
        ("Zlib", "zlib License\n(C) 1995 Someone\n" + wrap(text["Zlib"])),
        ("Unlicense", wrap(text["Unlicense"])),
        (None, text["MIT"] + " And more."),
        (None, text["MIT"].replace("free of charge", "for a fee")),
    ]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(copies)], "doc_id long, text string")).collect()}
    assert [got[i].license_id for i in range(len(copies))] == [n for n, _ in copies]


FULL_TEXTS = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause-UC", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_full_license_texts(spark):
    """The digests of full texts are those of the copies that Debian systems hold, also wrapped elsewhere."""
    at = Path("/usr/share/common-licenses")
    here = [(i, (at / n).read_text(encoding="utf-8", errors="replace")) for n, i in FULL_TEXTS.items() if (at / n).exists()]
    if not here:
        pytest.skip("no licence texts on this machine")
    got = license_scan.scan(spark.createDataFrame([*here, *((i, t.replace("\n", "\r\n").replace('"', "'")) for i, t in here)], "doc_id string, text string")).collect()
    assert len(got) == 2 * len(here) and all(r.license_id == r.doc_id for r in got)


# 8 toxicity


def test_toxicity_held_out(spark):
    part = DATA.replace("sf0.001", "sf0.1")
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{part}/labels.parquet").collect()}
    got = [(r.score, r.predicted, label[r.doc_id]) for r in catalog.op8_toxicity(spark, part).collect() if r.held_out and r.doc_id in label]
    ones, zeros = [s for s, _, y in got if y], [s for s, _, y in got if not y]
    assert np.mean([[(a > b) + (a == b) / 2 for b in zeros] for a in ones]) > 0.96
    assert np.mean([p for _, p, y in got if not y]) < 0.01 and np.mean([p for _, p, y in got if y]) > 0.75


def test_toxicity_edges(spark, messy, clashing, none):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scorer = toxicity.fit(documents(spark), labels)
    got = toxicity.score(messy, scorer, ["doc_id"]).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows()) and all(0 <= r.score <= 1 for r in got)
    same_rows(toxicity.score(clashing, scorer, ["doc_id"]), toxicity.score(messy, scorer, ["doc_id"]))
    assert toxicity.fit(none, labels) is None and toxicity.fit(messy, labels.where("toxic = 0")) is None
    assert toxicity.score(none, scorer, ["doc_id"]).count() == 0
    assert {r.score for r in toxicity.score(messy, None, ["doc_id"]).collect()} == {0.0}


def test_toxicity_of_long_texts(spark):
    """Where all toxic texts are long, pieces of them are learned from."""
    rng = np.random.default_rng(0)
    plain = lambda n: " ".join(f"word{i}" for i in rng.integers(0, 300, n))
    docs = [(i, (plain(2500) + " you vile wretch " + plain(10)) * 2 if i % 3 == 0 else plain(50 + i)) for i in range(150)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)], "doc_id long, toxic int")
    scorer = toxicity.fit(rows, labels)
    assert scorer is not None and len({round(r.score, 6) for r in toxicity.score(rows, scorer, ["doc_id"]).collect()}) > 2


def test_rare_languages_are_learned(spark):
    """A language of 1 in 500 rows beside one text with many copies: each language has its share of different texts."""
    rng = np.random.default_rng(0)
    word = lambda letters: "".join(letters[i] for i in rng.integers(0, len(letters), 6))
    texts = [(" ".join(word("abcdefgh") for _ in range(30)), "x") for _ in range(4000)] + [("one text again and again", "x")] * 4000 + [(" ".join(word("pqrstuvw") for _ in range(30)), "rare") for _ in range(16)]
    df = spark.createDataFrame(texts, "text string, lang string")
    net = langid.fit(df, sample_rows=300)
    assert net.classes == ["rare", "x"]
    got = langid.identify(df.where("lang = 'rare'").select("text", F.monotonically_increasing_id().alias("id")), net, ["id"]).collect()
    assert all(r.lang_pred == "rare" for r in got)


# 9 quality


def test_quality(messy, clashing, none):
    got = {(r.doc_id, r.n_words): r for r in quality.clean_lines(messy).collect()}
    for i, t, *_ in rows():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        r = got[i, len(w)]
        where = defaultdict(list)
        for j in range(len(w) - 7):
            where[tuple(w[j : j + 8])].append(j)
        hit = {k for v in where.values() if len(v) > 1 for j in v for k in range(j, j + 8)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.word_chars, r.n_repeat_words, r.n_dup_lines) == (sum(map(len, w)), len(hit), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
    assert got[6, 60].kept and got[12, 40_000].kept and not got[15, 11].kept
    same_rows(quality.clean_lines(clashing), quality.clean_lines(messy))
    assert quality.clean_lines(none).count() == 0


def test_quality_of_prose_and_of_pages(spark):
    """Quotations of several languages and prose that mentions a cookie stay; menus, crumbs and notices go."""
    french = "\n".join(f"Elle répondit « oui, jour{i} » puis, après silence{i}, ajouta encore « non, nuit{i} » et partit{i}." for i in range(12))
    german = "\n".join(f"Er sagte »ja, am Tag{i}« und nach Stunde{i} rief sie »nein, niemals{i}« durch das Haus{i}." for i in range(12))
    prose = "The chef baked a cookie, and I will sign up for the class that starts next week, since nobody else in the whole town bakes anything half as good."
    page = "Home | News | Sport | Contact\nhome > shop > shoes > red\nWe use cookies to improve your visit. Read more.\nCliquez ici!\nHome\nAll rights reserved.\n" * 3
    page += "\n".join(f"Menu {i} » entry {i} » leaf {i}" for i in range(9))
    got = {r.doc_id: r for r in quality.clean_lines(spark.createDataFrame(list(enumerate([french, german, prose, page, prose + "\nNo other bakery is open.\nWe use cookies."])), "doc_id long, text string")).collect()}
    assert [got[i].kept for i in range(5)] == [True, True, True, False, True]
    assert got[0].clean_text == french and got[1].clean_text == german and got[2].clean_text == prose and got[3].clean_text.strip() == ""
    assert "cookies" not in got[4].clean_text


# 10 decontamination


def search(docs, items):
    out = {}
    fold = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
    for i, t in docs:
        w, hit, found = fold(t), set(), set()
        for item, text in items:
            b = fold(text)
            k = min(10, len(b))
            for a in range(len(b) - k + 1) if b else ():
                for j in range(len(w) - k + 1):
                    if w[j : j + k] == b[a : a + k]:
                        hit |= set(range(j, j + k))
                        found.add(item)
        out[i] = (len(w), len(hit), sorted(found))
    return out


def test_decontamination(spark, messy, clashing, none):
    item = " ".join(f"beta{i}" for i in range(20, 45))
    items = [("b", item), ("a", "Hello, WORLD"), ("c", ""), ("d", None), ("e", "..."), ("f", "漢字"), ("g", "one"), ("h", item + " tail"), ("i", "c d a")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = search([(r[0], r[1]) for r in rows() if r[0] is not None and r[1] != LONG], items)
    for block, sent in ((decontam.BLOCK_BYTES, decontam.SENT_BYTES), (5, decontam.SENT_BYTES), (5, 60)):
        got = decontam.find_contamination(messy, bench, block_bytes=block, sent_bytes=sent).collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got if r.doc_id in want} == want
        assert all(sum(s.end - s.first for s in r.hit_spans) == r.n_hit for r in got)
    same_rows(decontam.find_contamination(clashing, bench), decontam.find_contamination(messy, bench))
    assert decontam.find_contamination(none, bench).count() == 0
    assert sum(r.n_hit for r in decontam.find_contamination(messy, bench.where("false")).collect()) == 0
    for block, sent in ((decontam.BLOCK_BYTES, decontam.SENT_BYTES), (5, 60)):
        kept = decontam.remove_contaminated(clashing, bench, block_bytes=block, sent_bytes=sent)
        assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in rows()} - {i for i, x in want.items() if x[1]}
    digest = decontam.contamination_digest(decontam.find_contamination(messy, bench)).collect()
    assert all(r.items_sha256 == hashlib.sha256(",".join(want[r.doc_id][2]).encode()).hexdigest() for r in digest if r.doc_id in want)


# long texts


def test_kernels_take_long_texts_in_pieces():
    """A text of 50 MB: the same windows, words, n-grams and hashes as from small parts, in bounded memory."""
    rng = np.random.default_rng(9)
    some = b" ".join(b"w%d" % x for x in rng.integers(0, 10**6, 40_000))
    data = np.frombuffer(some + b" " + b"x" * (9 << 20) + b" " + some * 160, np.uint8)
    assert len(data) > 50 << 20
    offsets = np.array([0, len(data)])
    tracemalloc.start()
    hashes, first = common.word_hashes(data, offsets)
    text, bounds, places, _ = decontam.folded(data, offsets)
    scorer = toxicity.Scorer(rng.standard_normal(1 << toxicity.BITS).astype(np.float32), 0.0)
    found, value = toxicity._of_long_text(text)
    assert tracemalloc.get_traced_memory()[1] < 1200 << 20
    tracemalloc.stop()
    small = np.frombuffer(some, np.uint8)
    want, _ = common.word_hashes(small, np.array([0, len(small)]))
    assert first.tolist() == [0, len(hashes)] and (hashes[: len(want)] == want).all() and (hashes[-len(want) + 1 :] == want[1:]).all()
    giant = common.run_hashes(data, np.array([len(some) + 1]), np.array([len(some) + 1 + (9 << 20)]))
    assert hashes[len(want)] == giant[0] == common.run_hashes(data, np.array([len(some) + 1]), np.array([len(some) + 1 + (9 << 20)]), piece=1 << 24)[0]
    assert len(places) == len(hashes) and bounds.tolist() == [0, len(text)] and bytes(text[:60]) == b" " + bytes(data[:59])
    a, b = toxicity._of_text(toxicity._features(text[: 1 << 20]), 0, 1 << 20)
    assert len(scorer.weights) > found.max() and np.isin(a, found).all() and value.max() >= b.max()
    one = toxicity._of_long_text(text[: 9 << 20])
    two = toxicity._of_text(toxicity._features(text[: 9 << 20]), 0, 9 << 20)
    assert (one[0] == two[0]).all() and np.allclose(one[1], two[1])


# the pipeline


def test_pipeline_stages(spark, messy, none, tmp_path):
    bench = spark.createDataFrame([("b", " ".join(f"beta{i}" for i in range(20, 45)))], "item_id string, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, wide = messy, messy.withColumn("shard", F.lit(1))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert out.columns == list(corpus_pipeline.COLUMNS), name
            assert stage(spark, none, str(tmp_path)).count() == 0
            assert stage(spark, wide, str(tmp_path)).columns == list(corpus_pipeline.COLUMNS)
        docs = common.materialise(out)
        ids = {r.doc_id for r in docs.collect()}
        assert i < 2 or not ids & {7, 11}
        assert not ids & {0, 1, 2, 3}
        assert i < 1 or not ids & {9, 13}
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontaminate", "mix", "shard"]


def test_pipeline_keeps_what_plain_versions_keep(spark):
    """run() over the whole table against each stage in plain Python, and its tables in the shared folder."""
    docs, bench = documents(spark), spark.read.parquet(f"{DATA}/benchmark.parquet")
    shared = Path(common.shared_dir(spark).removeprefix("file://"))
    before = set(shared.glob("tidewell-pipeline-*"))
    out = corpus_pipeline.run(spark, DATA).collect()
    assert {p.name.split("-")[2] for p in set(shared.glob("tidewell-pipeline-*")) - before} == {"shard"}
    rows = {r.doc_id: r for r in docs.collect()}
    judged = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs), ["doc_id"]).collect()}
    kept = {i: r for i, r in rows.items() if re.search(r"[^\W\d_]", r.text or "") and judged[i].score >= corpus_pipeline.LEAST_SCORE}
    near = brute([(i, r.text) for i, r in kept.items()], 5, 80)
    kept = {i: r for i, r in kept.items() if near[i][1] == i}
    grams = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    windows = defaultdict(set)
    for r in bench.collect():
        w = grams(r.text)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[min(10, len(w))].add(tuple(w[j : j + 10]))
    hit = lambda w: any(tuple(w[j : j + k]) in some for k, some in windows.items() for j in range(len(w) - k + 1))
    kept = {i: r for i, r in kept.items() if not hit(grams(r.text))}
    n = Counter(r.source for r in kept.values())
    scale = len(kept) / sum(v**0.5 for v in n.values())
    want = Counter()
    for i, r in kept.items():
        rate = n[r.source] ** 0.5 * scale / n[r.source]
        parts, copies = max(1, -int(-rate // 16)), 0
        for j in range(1, parts + 1):
            u = int(hashlib.md5(f"tidewell:{i}:{hashlib.md5(r.text.encode()).hexdigest()}:{j}".encode()).hexdigest()[:13], 16) / 2**52
            p = c = math.exp(-rate / parts)
            k = 0
            while c <= u and k < 73:
                k += 1
                p *= rate / parts / k
                c += p
            copies += k
        want[i] = copies
    assert Counter(r.doc_id for r in out) == +want
    assert all((r.text, r.lang, r.source) == (rows[r.doc_id].text, rows[r.doc_id].lang, rows[r.doc_id].source) for r in out)
    total = Counter()
    for r in out:
        assert r["size"] == len(r.text.encode()) + 1
        total[r.shard] += r["size"]
    groups = Counter()
    for r in out:
        groups[hashlib.md5(r.text.encode()).hexdigest()[:15]] += r["size"]
    assert max(total.values()) <= minimax([groups[k] for k in sorted(groups)], corpus_pipeline.SHARDS)
    for k in total:
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))


def test_pipeline_rejects_unknown_scripts(spark):
    """A text in an alphabet of no labelled language goes; the labelled languages stay."""
    net = langid.fit(documents(spark, DATA.replace("sf0.001", "sf0.01")))
    japanese = "人は地上に住み、毎日働く。仕事は幸福に必要だからである。子供たちは学校へ行く。" * 5
    english = next(r.text for r in documents(spark).where("lang = 'en' AND n_chars > 300").take(1))
    docs = spark.createDataFrame([(1, japanese), (2, english), (3, "12 34 !")], "doc_id long, text string")
    assert [r.doc_id for r in langid.keep_identified(docs, net, corpus_pipeline.LEAST_SCORE).collect()] == [2]
