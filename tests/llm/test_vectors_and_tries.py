"""Vector codes, projected neighbours and the trie of conversations against brute force, on awkward rows and on skewed ones."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tests.conftest import DATA, compare
from tests.llm.test_ops import SPLIT

from marketloom.llm import lloyd, projections, queries, trie

VECTORS = "vec_id long, embedding array<double>, label int, code string, v string, id string, p string"


def awkward_vectors(seed=5, n=120, dim=8):
    rnd = random.Random(seed)
    draw = lambda d=dim: [rnd.gauss(0, 1) for _ in range(d)]
    rows = [(i, draw(), rnd.choice([0, 1, None])) for i in range(n)]
    one = draw()
    rows += [(200 + i, one, 2) for i in range(60)] + [(300, one, None), (300, one, None), (5, draw(), 1), (None, draw(), 0), (None, one, 0)]
    rows += [(400, None, 1), (401, [1.0, None] + [0.0] * 6, 1), (402, [math.nan] + [0.0] * 7, 1), (403, [math.inf] + [0.0] * 7, 1), (404, [], 1), (500, [0.0] * dim, 1), (501, [-0.0] * dim, 1)]
    rows += [(600 + i, draw(3), 3) for i in range(5)] + [(700, [1e300] * dim, 4), (800, [-1e300, 1e300] * (dim // 2), 4), (900, [1e-200] * dim, 4)]
    rnd.shuffle(rows)
    return [(*r, "c", "v", "i", "p") for r in rows]


def sound_rows(rows):
    return [(i, x, label) for i, x, label, *_ in rows if x is not None and all(c is not None and math.isfinite(c) for c in x)]


# -- vector codes -------------------------------------------------------------------------------------------------


def brute_codes(rows, entries, rounds=4):
    limit, out, errors = (1 << 63) - 1, [], defaultdict(int)
    held = defaultdict(list)
    for i, x, label in sound_rows(rows):
        held[len(x)].append((i, x, [max(-(2**62), min(2**62, math.floor(1024 * c))) if math.isfinite(1024 * c) else int(math.copysign(2**62, c)) for c in x], label))
    for dim, own in held.items():
        own.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        ends = [dim * k // 4 for k in range(5)]
        parts = [[(v[a:b]) for _, _, v, _ in own] for a, b in zip(ends, ends[1:])]
        books = [p[:entries] for p in parts]
        near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))
        for _ in range(rounds):
            for k, p in enumerate(parts):
                to = defaultdict(list)
                for x in p:
                    to[near(x, books[k])[1]].append(x)
                books[k] = [[sum(c) // len(to[e]) for c in zip(*to[e])] if e in to else x for e, x in enumerate(books[k])]
        told = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
        for n, (i, _, _, label) in enumerate(own):
            found = [near(parts[k][n], books[k]) for k in range(4)]
            out.append((i, "".join(f"{k:02x}" for _, k in found), min(limit, sum(d for d, _ in found)), label, told))
    for _, _, e, label, _ in out:
        errors[label] += e
    return [(i, c, e, min(limit, errors[label]), told) for i, c, e, label, told in out]


@pytest.mark.parametrize("block,entries", [(16384, 16), (50, 256)])
def test_codes_by_brute_force(spark, monkeypatch, block, entries):
    monkeypatch.setattr(lloyd, "BLOCK", block)
    rows = awkward_vectors()
    got = lloyd.compress(spark.createDataFrame(rows, VECTORS).repartition(3), entries=entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert order(got.collect()) == order(brute_codes(rows, entries))


def test_boxes_eliminate_entries():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (64, 4))
    points = (centres[rng.integers(0, 64, 20_000)] + rng.normal(0, 40, (20_000, 4))).astype(np.int64)
    points[:7000] = points[0]  # a third of all rows are one point
    book = points[rng.choice(20_000, 256, replace=False)]
    entry, sums, counts, taken = lloyd.filtered(lloyd.grow(points), book)
    want = ((points[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (entry[np.argsort(lloyd.grow(points).order)] == want).all() and (counts == np.bincount(want, minlength=256)).all()
    assert all((sums[k] == points[want == k].sum(0)).all() for k in range(256))
    assert taken < 0.25 * 256 * len(points)  # distances and tests together


def test_codes_oracle(spark, duck):
    compare(queries.op11_filtering_lloyd(spark, DATA), duck, lloyd.ORACLE)


def test_codes_empty(spark):
    assert lloyd.compress(spark.createDataFrame([], VECTORS)).count() == 0
    assert lloyd.compress(spark.createDataFrame([(1, None, 1, "", "", "", "")], VECTORS)).count() == 0


# -- projected neighbours -----------------------------------------------------------------------------------------


def brute_neighbours(rows, every, k=10):
    """Exact neighbours of each query row: sorted lists of (distance, null id last, id)."""
    rows = [(i, np.array(x)) for i, x, _ in sound_rows(rows) if any(x)]
    out = []
    for n, (q, x) in enumerate(rows):
        if q is not None and q % every == 0:
            near = [(float(projections.distances(y[None], x)[0]), i is None, i or 0) for m, (i, y) in enumerate(rows) if m != n and len(y) == len(x)]
            out.append((q, sorted(near)[:k]))
    return out


def recall(got, want):
    """got: query_id, rank, vec_id, score. Checks order and scores on the way."""
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append((r["rank"], r.score, r.vec_id is None, r.vec_id or 0))
    hit = total = 0
    for q, near in want:
        mine = sorted(by[q])
        copies = sum(1 for i, _ in want if i == q)
        assert len(mine) == sum(len(n) for i, n in want if i == q)
        ranked = sorted(m[1:] for m in mine)
        assert sorted({m[0] for m in mine}) == list(range(1, len(near) + 1)), copies
        kth = near[-1][0] if near else 0
        hit += min(len(near), sum(m[0] <= kth for m in ranked) / copies)
        total += len(near)
    return hit / max(1, total)


@pytest.mark.parametrize("block,cells", [(4096, 4096), (16, 8)])
def test_neighbours_awkward(spark, block, cells):
    rows = awkward_vectors()
    got = projections.search(spark.createDataFrame(rows, VECTORS).repartition(3), every=5, block=block, most_cells=cells).collect()
    want = brute_neighbours(rows, 5)
    assert {q for q, _ in want} == {r.query_id for r in got}
    assert recall(got, want) >= 0.95
    one = [r for r in got if r.query_id == 200]  # one of many copies: ties by id, without itself
    assert [r.vec_id for r in sorted(one, key=lambda r: r["rank"])] == list(range(201, 211)) and all(r.score == 0 for r in one)
    twice = sorted((r["rank"], r.vec_id) for r in got if r.query_id == 300)
    assert twice == sorted([(k + 1, 200 + k) for k in range(10)] * 2)


def test_neighbours_recall_and_work(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(200, 32))
    x = centres[rng.integers(0, 200, 6000)] + 0.05 * rng.normal(size=(6000, 32))
    x[:2000] = x[7]  # a third of all rows are copies
    rows = [(i, [float(c) for c in v], 0, "", "", "", "") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, VECTORS)
    got = projections.search(df, every=100, block=256, most_cells=16).collect()
    assert recall(got, brute_neighbours(rows, 100)) >= 0.95
    block = projections.Block(projections._build(11)((pa_int(32), pa_int(0), pa_int(0)), block_table(x[2000:])).to_pylist()[0], False)
    work = [block.search(x[i], projections.project(x[i : i + 1])[0].astype(float), 11, float("inf"), projections.quantile(0.95))[2] for i in range(2000, 6000, 100)]
    assert np.mean(work) < 0.1 * 4000  # vectors verified


def pa_int(i):
    import pyarrow as pa

    return pa.scalar(i)


def block_table(x):
    import pyarrow as pa

    return pa.table({"id": pa.array(np.arange(len(x))), "v": [v.tobytes() for v in x], "p": [p.tobytes() for p in projections.project(x)], "digest": [projections._digest(v) for v in x]})


def test_stopping_test():
    for few, p, want in ((16, 0.95, 26.296), (2, 0.5, 1.3863), (8, 0.99, 20.090)):
        assert abs(projections.quantile(p, few) - want) < 1e-3


def test_neighbours_real(spark):
    got = queries.op13_projection_neighbours(spark, DATA)
    assert got.schema.simpleString() == "struct<query_id:bigint,rank:int,vec_id:bigint,score:double>"
    rows = [(r.vec_id, [float(c) for c in r.embedding], 0) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert recall(got.collect(), brute_neighbours(rows, 100)) >= 0.9


def test_neighbours_empty(spark):
    assert projections.search(spark.createDataFrame([], VECTORS)).count() == 0
    assert projections.search(spark.createDataFrame([(100, [1.0, 2.0], 0, "", "", "", "")], VECTORS)).count() == 0


# -- conversations ------------------------------------------------------------------------------------------------

CONVERSATIONS = "conv_id long, turn long, role string, text string, key string, pos string, words string, weight string"


def awkward_conversations(seed=2):
    rnd = random.Random(seed)
    rows = []
    for c in list(range(60)) + [-3, -20, 400, 419, 10**12]:
        kind, n = rnd.randrange(4), rnd.randrange(0, 7)
        for t in range(n):
            rows.append((c, t, rnd.choice(["user", "assistant"]) if kind else "user", rnd.choice(["a b", "c", "", None]) if kind else f"say {t}"))
    rows += [(7, None, None, "first of all"), (7, None, None, None), (7, 2, "user", "twice"), (7, 2, "user", "twice"), (7, 2, "assistant", "z")]
    rows += [(None, 0, "user", "x"), (None, None, None, None)]
    rows += [(1000 + c, t, "user", f"the same in {t}") for c in range(90) for t in range(9)]  # copies, a third of all
    rows += [(2000, t, "user", "on and on " * (t % 5)) for t in range(400)] + [(2020, t, "user", "on and on " * (t % 5)) for t in range(395)]
    rows += [(3000 + c, t, "user", f"shared {t}" if t < 12 else f"own {c} {t}") for c in range(0, 60, 20) for t in range(20)]
    rows += [(4000, 0, "user", "x" * 100_000 + " y")]
    rnd.shuffle(rows)
    return [(*r, "k", "p", "w", "t") for r in rows]


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    convs = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        convs[c] = turns.get(base, [])[:h] + own[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, m in members.items():
        own = (len(m) - 1) * len(SPLIT(path[-1][1])) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += own
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items()
    )


@pytest.mark.parametrize("most_rows,a_task", [(1 << 15, 1 << 14), (100, 40), (4, 3)])
def test_trie_by_brute_force(spark, most_rows, a_task):
    rows = awkward_conversations()
    got = trie.prefix_trie(spark.createDataFrame(rows, CONVERSATIONS).repartition(5), most_rows, a_task)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in got.dtypes} == {"bigint", "string"}
    assert sorted(map(tuple, got.collect())) == brute_trie(rows)


def test_ids_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 20)
    members = spark.createDataFrame([(c, 0, c % 3, 100) for c in range(300)] + [(7, 0, 7, 1)], "conv long, length long, class long, weight long").repartition(4)
    want = {k: hashlib.sha256(",".join(str(c) for c in range(k, 300, 3)).encode()).hexdigest() for k in range(3)} | {7: hashlib.sha256(b"7").hexdigest()}
    assert {r["class"]: r.ends_sha256 for r in trie.ends_digests(members).collect()} == want


def test_trie_oracle(spark, duck):
    compare(queries.op12_conversation_trie(spark, DATA), duck, trie.ORACLE)


def test_trie_empty(spark):
    assert trie.prefix_trie(spark.createDataFrame([], CONVERSATIONS)).count() == 0
    alone = spark.createDataFrame([(41, 0, "user", "x", "", "", "", "")], CONVERSATIONS)  # its only turn gives way, and nothing comes instead
    assert zlib.crc32(b"41") % 4 and sorted(map(tuple, trie.prefix_trie(alone).collect())) == brute_trie([(41, 0, "user", "x")])
