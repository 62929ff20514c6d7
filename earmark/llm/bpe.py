"""Byte-level BPE by forced-boundary splitting.

A byte pair that occurs inside no token of the vocabulary can never be merged over: between its two
bytes every encoding has a token boundary. A piece of text is cut at all such pairs, the fragments are
merged on their own, and their ids are concatenated. Fragments are short and repeat, so a worker
keeps what it has merged in bounded tables; a long text without spaces is still cut.

Before the cuts a text is divided as the vocabulary's own pattern divides it, and special tokens
written out in a text stand for themselves. Decoding concatenates the bytes of the tokens.

Defined results: a null or empty text has no ids and decodes to the empty text; equal rows give
equal rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from earmark.llm.common import kept, named, sliced, small_batches
from earmark.llm.pieces import CUT

# the division into pieces that byte-level vocabularies of this family state as their pattern (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# words and their characters that one of two generations holds
MAX_ENTRIES = 400_000
MAX_ENTRY_CHARS = 10_000_000
# symbols up to which a fragment is merged by plain scans
SHORT = 24
NO_MERGE = (1 << 60, -1)


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: visible Latin-1 characters stand for themselves, the
    other bytes follow from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ForcedBoundaryBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(letters[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.byte_id = [vocab[c] for c in sorted(letters, key=letters.get)]
        self.merges = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[left], vocab[right]] = (rank, vocab[left + right])
        inside = np.zeros((256, 256), dtype=bool)
        for token, i in vocab.items():
            if token not in self.special:
                b = np.frombuffer(self.bytes_of[i], dtype=np.uint8)
                inside[b[:-1], b[1:]] = True
        self.inside = inside
        self.inside_flat = inside.tobytes()
        self.divide = regex.compile(PATTERN).findall
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None
        self.fragments: dict[bytes, tuple[int, ...]] = {}
        self.earlier: dict[bytes, tuple[int, ...]] = {}
        # the words of late and the generation before; a word met again moves up
        self.entries: dict[str, tuple[str, bytes]] = {}
        self.old: dict[str, tuple[str, bytes]] = {}
        self.chars = 0

    def cut(self, piece: bytes) -> list[bytes]:
        """Fragments between forced boundaries."""
        if len(piece) > 256:
            b = np.frombuffer(piece, dtype=np.uint8)
            at = (np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1).tolist()
        else:
            flat = self.inside_flat
            at = [i for i in range(1, len(piece)) if not flat[piece[i - 1] << 8 | piece[i]]]
        if not at:
            return [piece]
        return [piece[a:b] for a, b in zip([0, *at], [*at, len(piece)])]

    def merge(self, fragment: bytes) -> tuple[int, ...]:
        """Ids of a fragment: the pair of lowest rank first, leftmost first."""
        ids = [self.byte_id[b] for b in fragment]
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get = self.merges.get
        found = [get(pair, NO_MERGE) for pair in zip(ids, ids[1:])]
        while found:
            best = min(found)
            if best is NO_MERGE:
                break
            at = found.index(best)
            ids[at : at + 2] = [best[1]]
            del found[at]
            if at < len(found):
                found[at] = get((ids[at], ids[at + 1]), NO_MERGE)
            if at:
                found[at - 1] = get((ids[at - 1], ids[at]), NO_MERGE)
        return tuple(ids)

    def _merge_long(self, ids: list[int]) -> tuple[int, ...]:
        merges, n = self.merges, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = merges[left, right][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (ids[a], ids[b]) in merges:
                    heapq.heappush(heap, (merges[ids[a], ids[b]][0], a, ids[a], ids[b]))
        return tuple(x for x in ids if x >= 0)

    def encode(self, text: str) -> list[int]:
        """Ids of any text, special tokens included."""
        ids: list[int] = []
        for part in self.split_special(text) if self.split_special else [text]:
            if part in self.special:
                ids.append(self.special[part])
                continue
            for piece in self.divide(part):
                for fragment in self.cut(piece.encode()):
                    merged = self.fragments.get(fragment)
                    if merged is None:
                        merged = self.earlier.get(fragment) or self.merge(fragment)
                        if len(fragment) <= 64:
                            self.fragments[fragment] = merged
                    ids.extend(merged)
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, sha256 of the ids, sha256 of the decoded text) of each text."""
        # every text is cut at spaces before visible characters, where a piece always begins
        parts = [CUT.split(t) for t in texts]
        wanted = {" " + w for w in {w for p in parts for w in p[1:]}} | {p[0] for p in parts}
        if len(self.entries) + len(wanted) > MAX_ENTRIES or self.chars > MAX_ENTRY_CHARS:
            self.old, self.entries, self.chars = self.entries, {}, 0
            self.earlier, self.fragments = self.fragments, {}
        entries, old = self.entries, self.old
        for w in wanted.difference(entries):
            entry = old.get(w)
            if entry is None:
                ids = self.encode(w)
                entry = (",".join(map(str, ids)), self.decode(ids))
            entries[w] = entry
            self.chars += len(w)
        out = []
        for p in parts:
            own = [entries[p[0]], *[entries[" " + w] for w in p[1:]]]
            joined = ",".join([e[0] for e in own if e[0]])
            decoded = b"".join([e[1] for e in own]).decode("utf-8", "replace")
            n = joined.count(",") + 1 if joined else 0
            out.append((n, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
        return out


def codec(path: str) -> ForcedBoundaryBpe:
    """The worker's codec for a vocabulary file, loaded once."""
    return kept(f"codec {path}", lambda: ForcedBoundaryBpe(path))


def round_trip(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(<id>, n_tokens, ids_sha256, decoded_sha256) of every document, encoded and decoded again."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer_path)
        for batch in batches:
            for rows, texts in sliced(batch, "text"):
                n, ids, decoded = zip(*own.digests(texts))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), pa.array(n, type=pa.int64()), pa.array(ids), pa.array(decoded)],
                    [id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return named(docs, [id_col, text_col]).toDF("id", "text").mapInArrow(digest, schema)


def encode_ids(docs: DataFrame, tokenizer_path: str, *, text_col: str = "text") -> DataFrame:
    """The table with a column ``ids`` (array of int) of its texts' token ids."""
    from pyspark.sql import functions as F

    small_batches(docs.sparkSession)

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        own = codec(tokenizer_path)
        return pa.array([own.encode(t or "") for t in texts.to_pylist()], type=pa.list_(pa.int32()))

    return docs.withColumn("ids", ids(F.col(f"`{text_col}`")))
