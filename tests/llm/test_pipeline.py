"""The registered pipeline at sf0.001, stage by stage, against plain loops."""

import collections
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from earmark.llm import pseudonyms, quality

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def groups_of(docs):
    """Components of documents by all pairs of sets: smallest id of each."""
    sets = {i: shingles(t) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(docs)
    for n, a in enumerate(order):
        for b in order[:n]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in docs}


def test_run_equals_its_stages_by_plain_loops(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect()}
    kept = dict(texts)
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == table.columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            model = quality.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
            kept = {i: t for i, t in kept.items() if model.scores([t])[0] >= 0.3}
        elif name == "language":
            kept = {i: t for i, t in kept.items() if re.search(r"[^\W\d_]", t or "")}
        elif name == "near_duplicates":
            root = groups_of(kept)
            kept = {i: t for i, t in kept.items() if root[i] == i}
        else:
            kept = {i: pseudonyms.pseudonymised(t, pseudonyms.DEMO_KEY)[0] for i, t in kept.items()}
        assert got == kept, name
    assert 0 < len(kept) < len(texts)
    placed = corpus_pipeline.run(spark, SF).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter()
    for i, text in kept.items():
        ids = whole.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in placed) == want
    windows = collections.defaultdict(list)
    for r in placed:
        windows[r.sequence_id].append((r.offset, r.length))
    for parts in windows.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 4096
    assert table.filter(F.col("doc_id").isNull()).count() == 0  # ids of the given table tell rows apart


def test_a_worker_gives_memory_back_between_stages(monkeypatch):
    from earmark.llm import common

    given = []
    monkeypatch.setattr(common, "_KEPT", {})
    monkeypatch.setattr(common, "give_back", lambda: given.append(dict(common._KEPT)))
    for stage in ("language", "language", "pieces", "pieces"):
        common.kept(stage, dict)
    assert given == [{}, {}]
    monkeypatch.undo()
    common.give_back()
