"""Signature trees, vector codes and importance resampling against plain versions, and on what tables may hold."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_llm_operators import brute, clashing, messy, none, rows, same_rows  # noqa: F401

from tidewell.llm import catalog, common, importance, signature_tree, vector_codes

# 11 signature trees


def families(rng, percent, largest):
    sets = []
    for _ in range(25):
        base = rng.integers(0, 2**63, int(rng.integers(1, largest)), np.uint64)
        for _ in range(int(rng.integers(1, 8))):
            x, edits = base.copy(), int(rng.integers(0, len(base) * (100 - percent) // 100 + 2))
            x[rng.integers(0, len(x), edits)] = rng.integers(0, 2**63, edits, np.uint64)
            sets.append(np.unique(np.concatenate([x, rng.integers(0, 2**63, int(rng.integers(0, 3)), np.uint64)])))
    return sets


def joined(n, pairs):
    label = np.arange(n)
    for i, j in pairs:
        label[label == max(label[i], label[j])] = min(label[i], label[j])
    return label.tolist()


@pytest.mark.parametrize("percent", [100, 90, 80, 50])
@pytest.mark.parametrize("largest", [6, 40, 300])
def test_trees_lose_no_link(percent, largest):
    """Linked sets have a class in common, and joined trees connect what brute force connects: within a tree and between two."""
    sets = families(np.random.default_rng(percent + largest), percent, largest)
    n = len(sets)
    pairs = [(i, j) for i in range(n) for j in range(i) if signature_tree.linked(sets[i], sets[j], percent)]
    keys, each = signature_tree.class_keys(np.concatenate(sets), np.cumsum([0, *map(len, sets)]), signature_tree.Bands(percent))
    classes = [set(x.tolist()) for x in np.split(keys, np.cumsum(each)[:-1])]
    assert all(classes[i] & classes[j] for i, j in pairs) and pairs
    sizes = np.array([len(x) for x in sets])
    maps = np.stack([signature_tree.bitmap(x, 256) for x in sets])
    assert (signature_tree.folded([signature_tree.bitmap(x, 256 << i % 3) for i, x in enumerate(sets)]) == maps).all()
    confirm = lambda i, j: signature_tree.linked(sets[i], sets[j], percent)
    whole = signature_tree.Tree(maps, sizes, np.arange(n))
    assert joined(n, signature_tree.join_trees(whole, whole, confirm, np.arange(n), percent)) == joined(n, pairs)
    left = np.random.default_rng(1).random(n) < 0.4
    one, other = (signature_tree.Tree(maps, sizes, np.flatnonzero(side)) for side in (left, ~left))
    assert joined(n, signature_tree.join_trees(one, other, confirm, np.arange(n), percent)) == joined(n, [(i, j) for i, j in pairs if left[i] != left[j]])


def test_trees_leave_pairs_of_nodes_early(monkeypatch):
    """Of 2,000 documents that share half of their words and aren't linked, few pairs of documents are looked at, and few as sets."""
    rng = np.random.default_rng(0)
    common_half = rng.integers(0, 2**63, 100, np.uint64)
    sets = [np.unique(np.concatenate([common_half, rng.integers(0, 2**63, 100, np.uint64)])) for _ in range(2000)]
    compared, looked = [], []
    tree = signature_tree.Tree(np.stack([signature_tree.bitmap(x, 2048) for x in sets]), np.full(2000, 200), np.arange(2000))
    real = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: looked.append(len(x)) or real(x))
    assert list(signature_tree.join_trees(tree, tree, lambda i, j: compared.append(1), np.arange(2000), 90)) == []
    assert len(compared) < 20 and sum(looked) < 0.2 * 2000 * 2000 / 2


@pytest.mark.parametrize("tree", [1 << 18, 300, 1])
def test_similar_documents(spark, messy, clashing, none, monkeypatch, tree):  # noqa: F811
    monkeypatch.setattr(signature_tree, "TREE", tree)
    want = brute([(r[0], r[1]) for r in rows() if r[0] is not None], 3, 90)
    got = signature_tree.similar_documents(messy).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows())
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.component_id is None for r in got if r.doc_id is None)
    if tree > 1:
        same_rows(signature_tree.similar_documents(clashing), signature_tree.similar_documents(messy))
        assert signature_tree.similar_documents(none).count() == 0


@pytest.mark.parametrize("tree", [1 << 18, 2000])
def test_similar_copies_of_one_text(spark, monkeypatch, tree):
    """A large group of edited copies, some linked by way of others only; equal texts; boilerplate that unlinked documents share."""
    monkeypatch.setattr(signature_tree, "TREE", tree)
    rng, docs = np.random.default_rng(6), []
    base = [f"b{i}" for i in range(150)]
    for i in range(150):
        w = list(base)
        for j in rng.choice(150, int(rng.integers(0, 6)), replace=False):
            w[j] = f"x{rng.integers(0, 40)}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, " ".join(base[:60] + [f"own{i}w{j}" for j in range(60)])) for i in range(100)] + [(400 + i, docs[i][1]) for i in range(30)]
    got = signature_tree.similar_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 3, 90)


# 12 vector codes


def compressed(vectors, parts=16, entries=64, rounds=2):
    """Rows (id, vector, label) by the definition, in Python's integers."""
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda x: (lambda a, b: a * 256 // b)(*float(x).as_integer_ratio())
    kept = sorted(((i, [whole(x) for x in v], label) for i, v, label in vectors if ok(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    assign = lambda: [[min((far(cut(v, p), e), k) for k, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in kept]
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [cut(kept[r][1], p) for r in range(len(kept)) if at[r][p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at, totals = assign(), Counter()
    for (_, _, label), a in zip(kept, at, strict=True):
        totals[label] += sum(d for d, _ in a)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    limit = lambda x: x if x < 1 << 63 else None
    return Counter((i, "".join(f"{k:02x}" for _, k in a), limit(sum(d for d, _ in a)), limit(totals[label]), sha) for (i, _, label), a in zip(kept, at, strict=True))


VECTORS = "vec_id long, embedding array<double>, label int"


def test_codes_are_brute_force(spark):
    rng = np.random.default_rng(3)
    table = [(int(i), (rng.standard_normal(32) * [0.1, 1, 30][i % 3]).tolist(), None if i % 7 == 0 else int(i % 4)) for i in rng.permutation(150)]
    table += [(200, [0.0] * 32, 1), (200, [0.0] * 32, 1), (None, [0.5] * 32, None), (201, None, 1), (202, [None] + [0.0] * 31, 1), (203, [float("nan")] * 32, 2), (204, [float("inf")] + [1.0] * 31, 2), (205, [1.0] * 5, 3), (206, [], 3)]
    got = vector_codes.compress(spark.createDataFrame(table, VECTORS).withColumns({"part": F.lit("clash"), "code": F.lit("clash"), "of": F.lit("clash"), "vector": F.lit("clash")}), entries=20)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == compressed(table, entries=20)


def test_codes_of_ties_few_rows_and_large_numbers(spark):
    ties = [(i, [float(i % 2)] * 16, 0) for i in range(12)]
    assert Counter(map(tuple, vector_codes.compress(spark.createDataFrame(ties, VECTORS)).collect())) == compressed(ties)
    large = [(i, [1e30 * (-1) ** i * (i + 1), 3e38] + [float(i)] * 14, i % 2) for i in range(6)]
    assert Counter(map(tuple, vector_codes.compress(spark.createDataFrame(large, VECTORS), entries=2).collect())) == compressed(large, entries=2)
    nothing = vector_codes.compress(spark.createDataFrame([(1, None, 1)], VECTORS))
    assert nothing.count() == 0 and nothing.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.fit(spark.createDataFrame([(1, [1.0] * 15, 1)], VECTORS))


def test_cells_leave_most_entries_out(spark, monkeypatch):
    """The bounds hold every nearest entry, and few others; a code's decoded vector lies about as far off as its error says."""
    rng = np.random.default_rng(0)
    books, queries = rng.integers(-200, 200, (64, 4)), rng.integers(-250, 250, (5000, 4))
    at, far = vector_codes.Cells(books).nearest(queries)
    all_far = ((queries[:, None, :] - books[None]) ** 2).sum(axis=2)
    assert (at == all_far.argmin(axis=1)).all() and (far == all_far.min(axis=1)).all()
    refined = []
    real = np.nonzero
    monkeypatch.setattr(np, "nonzero", lambda x: refined.append(x.sum()) or real(x))
    vector_codes.Cells(books).nearest(queries)
    assert refined[0] < 0.15 * all_far.size
    vectors = spark.read.parquet(f"{DATA}/embeddings.parquet").limit(100)
    trained = vector_codes.fit(vectors)
    codes = {r.vec_id: r for r in vector_codes.encode(vectors, trained).collect()}
    for r in vectors.collect():
        off = sum((x - y) ** 2 for x, y in zip(r.embedding, trained.decode(codes[r.vec_id].code), strict=True))
        assert abs(math.sqrt(off) - math.sqrt(codes[r.vec_id].error) / 256) < math.sqrt(64) / 256


# 13 importance resampling


def weighed(docs, target, longest=1, buckets=10_000, percent=10):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    each = [(i, *features(t)) for i, t in docs]
    own, other = Counter(b for _, _, f in each for b in f), Counter(b for t in target for b in features(t)[1])
    S, T = own.total(), other.total()
    gain = {b: math.floor(1000 * math.log((other[b] + 1) * (S + buckets) / ((own[b] + 1) * (T + buckets)))) for b in own}
    out = []
    for i, n, f in each:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    drawn = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        r[5] = rank
    return Counter((r[0], *r[2:]) for r in out)


@pytest.mark.parametrize("longest", [1, 3])
def test_importance(spark, messy, clashing, none, longest):  # noqa: F811
    bench = spark.createDataFrame([(0, " ".join(f"beta{i}" for i in range(20, 45))), (1, None), (2, "")], "item_id long, text string")
    docs, target = [(r[0], r[1]) for r in rows()], [r.text for r in bench.collect()]
    got = importance.importance(messy, bench, longest=longest, percent=50)
    assert Counter(map(tuple, got.collect())) == weighed(docs, target, longest, percent=50)
    same_rows(importance.importance(clashing, bench, longest=longest, percent=50), got)
    assert importance.importance(none, bench).count() == 0
    assert Counter(map(tuple, importance.importance(messy, bench.where("false"), percent=50).collect())) == weighed(docs, [], percent=50)


def test_importance_over_whole_tables(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    want = weighed([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in bench.collect()])
    assert Counter(map(tuple, catalog.op13_importance(spark, DATA).collect())) == want
    drawn = importance.resample(docs, bench)
    assert drawn.columns == docs.columns and {r.doc_id for r in drawn.collect()} == {r[0] for r in want if r[4] is not None}


def test_matrix_of_long_texts_and_words(spark):
    """A text of more than one piece, a word of 100 kB, words beside each other's texts: rows of the matrix and their sums."""
    texts = ["a" * 100_000 + " b", "x" * 47 + " " + "x" * 48 + " " + "x" * 49, "", None, "é漢 é漢 Z9", " ".join(f"w{i % 5000}" for i in range(900_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: Counter(zlib.crc32(w.lower().encode()) % 997 for w in (t or "").split()) for i, t in enumerate(texts)}
    blocks = common.materialise(importance.count_matrix(docs, 997))
    got = {}
    for b in blocks.collect():
        for k, i in enumerate(b.doc_ids):
            lo, hi = b.indptr[k : k + 2]
            got[i] = Counter(dict(zip(b.buckets[lo:hi], b.counts[lo:hi], strict=True)))
            assert b.n_words[k] == b.n_features[k] == got[i].total()
    assert got == want
    assert importance.column_sums(blocks, 997) == sum(want.values(), Counter())


def test_blocks_come_in_small_batches(spark):
    """A task reads and passes on a few blocks of a megabyte at once, however large its partition is."""
    blocks = spark.range(40, numPartitions=1).select(F.transform(F.sequence(F.lit(0), F.lit(262_143)), lambda i: F.hash("id", i)).alias("x"))
    sizes = common.map_arrow(blocks, lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
    assert len(sizes) > 2 and max(r.n for r in sizes) <= 2 * common.GROUP_BYTES
    held, drop = common.stored(blocks, "blocks", common.GROUP_BYTES)
    groups = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in held.inputFiles()]
    assert sum(g.num_rows for g in groups) == 40 and max(g.row_group(i).num_rows for g in groups for i in range(g.num_row_groups)) < 20
    drop()
