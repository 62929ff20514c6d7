"""Clustering, alignment and slack packing against plain loops, through the registered queries and on odd tables."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from earmark.llm import alignment, catalog, centroids, slack

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "  two  spaces ", "line\nbreak\n\nand\ttab", "<|endoftext|> <s> plain", "piece ▁ sign", "naïve café, 日本 😀.",
         "word " * 3000, "x" * 3000, "same text here", "same text here", "\n", " lead", "\x1cctrl\x85"]


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated ids, null, empty and long texts, and columns named like internal ones."""
    columns = ["id", "part", "rank", "ids", "block", "pair", "n", "_n", "a.b", "sequence_id"]
    rows = [(None if i == 3 else i // 2, t, *["clash"] * len(columns)) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in columns))


# --- clustering


def plain_clusters(rows, clusters, rounds):
    """(vec_id, cluster, distance) and centroids by whole numbers of Python."""
    kept = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    middles = [r[1] for r in order[:clusters]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, m)) for m in middles]
            out.append((i, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(middles)):
            own = [v for (_, v), (_, k, _) in zip(kept, found) if k == c]
            if own:
                middles[c] = [sum(x) // len(own) for x in zip(*own)]
    return assign(), middles


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, 6)).round(2)
    x[40:90] = x[0]  # a large group of equal vectors
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(7, [0.5] * 6), (7, [0.5] * 6)]
    bad = [(900, None), (901, [0.1] * 5), (902, [None] + [0.1] * 5), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [])]
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows + bad], "vec_id long, embedding array<double>, cluster string, apex double")
    got, middles = centroids.cluster(df, clusters=12, rounds=3, dimensions=6)
    want, plain = plain_clusters(rows, 12, 3)
    assert collections.Counter((r.vec_id, r.cluster, r.distance) for r in got.collect()) == collections.Counter(want)
    assert middles.tolist() == plain
    few, found = centroids.cluster(df.filter("vec_id < 3"), clusters=12, dimensions=6)
    assert len(found) == 3 and few.count() == 3 and few.agg({"distance": "sum"}).first()[0] == 0
    none, found = centroids.cluster(df.filter("false"), dimensions=6)
    assert none.count() == 0 and len(found) == 0
    with pytest.raises(Exception, match="beyond 2"):
        centroids.cluster(spark.createDataFrame([(1, [1e9] * 6)], "vec_id long, embedding array<double>"), dimensions=6)


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (400, 32)) // 3 + 40 * rng.integers(-3, 4, (8, 32))[rng.integers(0, 8, 400)]
    points = x[:20].astype(np.int64)
    simplex = centroids.Simplex.over(points, 12)
    assert len(simplex.pivots) == 12
    a, c = simplex.apexes(x), simplex.apexes(points)
    exact = centroids.squared(x, points)
    flat = ((a[:, None, :-1] - c[None, :, :-1]) ** 2).sum(axis=2)
    margin = centroids.MARGIN * exact.max()
    assert (flat + (a[:, None, -1] - c[None, :, -1]) ** 2 <= exact + margin).all()
    assert (flat + (a[:, None, -1] + c[None, :, -1]) ** 2 >= exact - margin).all()
    best, distance, compared = centroids.nearest(x, a, points, c)
    assert (best == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all() and compared < exact.size
    same = centroids.Simplex.over(np.zeros((5, 4), dtype=np.int64), 3)  # equal points: one pivot
    assert len(same.pivots) == 1 and same.apexes(np.full((2, 4), 3))[:, -1].tolist() == [6.0, 6.0]


def test_registered_clusters(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    fit = [(r.vec_id, r.embedding) for r in rows if r.embedding and len(r.embedding) == 64 and all(v is not None and np.isfinite(v) for v in r.embedding)]
    want, middles = plain_clusters(fit, 40, 5)
    inertia = collections.Counter()
    for _, c, d in want:
        inertia[c] += d
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in middles]
    total = sum(inertia.values())
    got = catalog.op11_centroid_clusters(spark, SF).collect()
    assert sorted(map(tuple, got)) == sorted((i, c, d, inertia[c], total, names[c]) for i, c, d in want)


# --- alignment


class PlainAlignment:
    """Spans, cuts and links of whole texts, from the libraries."""

    def __init__(self):
        self.a, self.b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in visible]
        self.letters = {chr(c): c for c in visible} | {chr(256 + i): c for i, c in enumerate(hidden)}

    def sides(self, text):
        a = [(i, bytes(self.letters[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            name = self.b.id_to_piece(i)
            b.append((i, bytes([int(name[3:5], 16)]) if self.b.is_byte(i) else name.replace("▁", " ").encode()))
        return a, b

    def __call__(self, text):
        """(n_a, n_b, groups, links)"""
        if not text:
            return 0, 0, [], []
        a, b = self.sides(text)
        if {b"".join(t for _, t in s) for s in (a, b)} != {(" " + text).encode()}:
            return 0, 0, [], []
        spans = []
        for side in (a, b):
            at, own = 0, []
            for i, t in side:
                own.append((at, at + len(t), i))
                at += len(t)
            spans.append(own)
        links, first = [], 0
        for s, e, i in spans[0]:
            while spans[1][first][1] <= s:
                first += 1
            for s2, _, j in spans[1][first:]:
                if s2 >= e:
                    break
                links.append((i, j))
        groups, start = [], 0
        for end in sorted({x[1] for x in spans[0]} & {x[1] for x in spans[1]}):
            groups.append("|".join(",".join(str(i) for _, e, i in own if start < e <= end) for own in spans))
            start = end
        return len(a), len(b), groups, links


def plain_alignment(rows):
    one = PlainAlignment()
    found = [(i, *one(t)) for i, t in rows]
    holds = collections.Counter(p for *_, links in found for p in set(links))
    most = collections.Counter()
    for (a, _), n in holds.items():
        most[a] = max(most[a], n)
    return collections.Counter(
        (i, n_a, n_b, len(groups), len(links), sum(holds[p] == most[p[0]] for p in links), sum(holds[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for i, n_a, n_b, groups, links in found
    )


def test_group_digests_equal_joined_ids():
    rng = random.Random(5)
    own, want, bounds = [[], [], [], []], [], [[0], [0]]
    for _ in range(60):
        groups = [[[rng.choice([0, 7, 9, 10, 99999, 65535, 65536, 123456]) for _ in range(rng.randint(1, 4))] for _ in "ab"] for _ in range(rng.randint(0, 5))]
        for group in groups:
            for side in (0, 1):
                own[side] += group[side]
                own[2 + side] += [False] * (len(group[side]) - 1) + [True]
        for side in (0, 1):
            bounds[side].append(len(own[side]))
        text = ";".join("|".join(",".join(map(str, ids)) for ids in group) for group in groups)
        want.append(hashlib.sha256(text.encode()).hexdigest() if groups else "")
    arrays = [np.array(x, dtype=kind) for x, kind in zip(own, (np.int64, np.int64, bool, bool))]
    assert alignment.group_digests(*arrays, *map(np.array, bounds)) == want
    none = np.zeros(0, dtype=np.int64)
    assert alignment.group_digests(none, none, none.astype(bool), none.astype(bool), np.zeros(3, int), np.zeros(3, int)) == ["", ""]


def test_alignment_of_odd_rows(spark, odd):
    got = alignment.aligned_documents(odd.repartition(3), A, B)
    want = plain_alignment([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert collections.Counter(map(tuple, got.collect())) == want
    assert alignment.aligned_documents(odd.filter("false"), A, B).count() == 0


def test_registered_alignment(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    short = [(r.doc_id, r.text) for r in rows]
    got = catalog.op12_token_alignment(spark, SF)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert collections.Counter(map(tuple, got.select(*names).collect())) == plain_alignment(short)


# --- slack packing


def test_fills_are_closest():
    rng = random.Random(1)
    for _ in range(200):
        counts = collections.Counter(rng.randint(1, 12) for _ in range(rng.randint(0, 6)))
        gap = rng.randint(0, 30)
        sums = {0}
        for n in counts.elements():
            sums |= {s + n for s in sums}
        chosen = slack.closest_fill(counts, gap)
        assert all(0 < k <= counts[n] for n, k in chosen.items())
        assert sum(n * k for n, k in chosen.items()) == max(s for s in sums if s <= gap)


@pytest.mark.parametrize("capacity, counts", [
    (7, {}), (7, {7: 3}), (30, {20: 101}), (1024, {1: 5000}), (1024, {700: 1}), (1024, {513: 64, 3: 2}), (64, None), (1024, None),
])
def test_windows_are_whole(capacity, counts):
    rng = random.Random(2)
    if counts is None:
        counts = collections.Counter(min(capacity, max(1, int(rng.lognormvariate(0, 1.2) * capacity / 5))) for _ in range(4000))
    covered, filled = collections.defaultdict(list), collections.defaultdict(list)
    for n, runs in slack.plan_windows(counts, capacity).items():
        for rank, count, start, length, sequence, per, offset, index in runs.tolist():
            for i in range(count):
                covered[n, rank + i].append((start, length))
                filled[sequence + (index + i) // per].append((offset + (index + i) % per * length, length))
    assert collections.Counter(n for n, _ in covered) == collections.Counter(counts)
    for (n, _), parts in covered.items():
        assert sum(k for _, k in parts) == n and [s for s, _ in sorted(parts)] == [sum(k for _, k in sorted(parts)[:i]) for i in range(len(parts))]
    for parts in filled.values():
        parts.sort()
        assert [s for s, _ in parts] == [sum(k for _, k in parts[:i]) for i in range(len(parts))]
        total = sum(k for _, k in parts)
        assert total == capacity or total & (total - 1) == 0
    assert sorted(filled) == list(range(len(filled)))


def check_windows(placed, rows, capacity=1024):
    """Pieces cover every document's ids once, windows have no gaps, and only powers of two stay below the capacity."""
    whole = Tokenizer.from_file(A)
    pieces = collections.defaultdict(list)
    for r in placed:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    want = collections.defaultdict(list)
    for doc_id, text in rows:
        ids = np.array(whole.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want[doc_id, len(ids)].append(ids)
    assert pieces.keys() == want.keys()
    for key, texts in want.items():
        if len(texts) == 1 or all((t == texts[0]).all() for t in texts):
            own = sorted(pieces[key])
            assert all(zlib.crc32(texts[0][s : s + n].tobytes()) == crc for s, n, crc in own)
        assert sum(n for _, n, _ in pieces[key]) == key[1] * len(texts)
        if len(texts) == 1:
            assert [s for s, _, _ in own] == [sum(n for _, n, _ in own[:i]) for i in range(len(own))]
    windows = collections.defaultdict(list)
    for r in placed:
        windows[r.sequence_id].append((r.offset, r.length))
    for own in windows.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        total = sum(n for _, n in own)
        assert total == capacity or (total < capacity and total & (total - 1) == 0)


def test_slack_packing_of_odd_rows(spark, odd):
    placed = slack.packed_documents(odd.repartition(3), A, with_ids=True)
    rows = placed.collect()
    check_windows(rows, [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    joined = {r.sequence_id: bytes(r.ids) for r in slack.sequences(placed).collect()}
    lengths = collections.Counter()
    for r in rows:
        lengths[r.sequence_id] += r.length
        assert joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == bytes(r.ids)
    assert {k: len(v) // 4 for k, v in joined.items()} == lengths
    assert slack.packed_documents(odd.filter("false"), A).count() == 0


def test_registered_slack_packing(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    check_windows(catalog.op13_slack_packing(spark, SF).collect(), [(r.doc_id, r.text) for r in rows])
