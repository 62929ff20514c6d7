"""Cross-tokenizer alignment by lockstep vectorised merging.

A text with a space before it is encoded by a byte-level vocabulary (A) and a piece vocabulary (B). Both token rows
cover the same bytes. One NumPy state vector holds the A and B pointers of all documents of a batch; each step emits the
link of every document's current pair, moves the pointer whose token ends first (both where both end, which is a
cut) and drops documents that are finished. A document is entered at word starts, where both vocabularies always
end a token, in fragments of at most ``FRAGMENT_WORDS`` words, so that a long document is many short rows of the state.

How many documents hold a pair of ids linked is counted over the whole corpus. Documents are kept in blocks of
bounded size, one row each, with their links; only a block's distinct pairs are shuffled: to be counted, and back
to their block with the counts. No link leaves its block otherwise.

Defined results: texts that are null or empty, and texts whose joined token bytes differ from the text with its space,
have no tokens: zeros and an empty ``groups_sha256``; special tokens' strings are plain text; repeated rows and ids
are documents of their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from earmark.llm.bpe import byte_letters
from earmark.llm.common import merged, named, sliced, small_batches, written
from earmark.llm.pieces import LETTERS, SIGNS, PieceEncoder, encoder, gather

FRAGMENT_WORDS = 64
# characters encoded at once, and of the documents of one block
SLICE_CHARS = 500_000
BLOCK_CHARS = 250_000
# pieces that each of a worker's two encoders remembers
KNOWN_PIECES = 200_000
MARK = "▁"  # stands for a space in pieces
_PIECES: dict[str, SentencePieces] = {}


class SentencePieces(PieceEncoder):
    """The same cuts for a sentencepiece model: no piece of it holds a space behind another character."""

    def _load(self, path: str, plain_specials: bool) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in n.lstrip(MARK) or "\n" in n for n in names):
            raise ValueError("the model has pieces across word starts")
        text = [n for i, n in enumerate(names) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        if any(re.search(f"[{LETTERS}][{re.escape(SIGNS)}]", n) for n in text):
            raise ValueError("the model has pieces of letters and signs")
        self.edge = np.array([n.startswith(MARK) for n in names])
        self.line = self.model.piece_to_id("<0x0A>")

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        """Texts begin with the space that the model adds, or with a line break."""
        out = []
        for text, ids in zip(texts, self.model.encode([t[1:] if t[:1] == " " else t for t in texts], num_threads=1)):
            ids = np.array(ids, dtype="<u4")
            out.append(ids if text[:1] == " " else ids[1:])  # before a line break the added space is a token of its own
        return out

    def _raw_signs(self, signs: list[str]) -> list[np.ndarray]:
        return [x[1:] for x in self._raw(["\n" + s for s in signs])]

    def _whole(self, text: str) -> np.ndarray:
        return self._raw([text])[0]


def sentence_pieces(path: str) -> SentencePieces:
    """The worker's encoder for a model file, loaded once."""
    if path not in _PIECES:
        _PIECES[path] = SentencePieces(path, True, limit=KNOWN_PIECES)
    return _PIECES[path]


class Vocabulary:
    """Bytes and decimal names of all ids, as one array each with places."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.bytes, self.starts[ids], self.sizes[ids])


_VOCABULARIES: dict[str, Vocabulary] = {}


def byte_vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        letters, tokenizer = byte_letters(), encoder(path, True, True, KNOWN_PIECES).tokenizer
        special = set(tokenizer.get_added_tokens_decoder())
        tokens = [b""] * (max(tokenizer.get_vocab().values()) + 1)
        for token, i in tokenizer.get_vocab().items():
            tokens[i] = token.encode() if i in special else bytes(letters[c] for c in token)
        _VOCABULARIES[path] = Vocabulary(tokens)
    return _VOCABULARIES[path]


def piece_vocabulary(path: str) -> Vocabulary:
    if path not in _VOCABULARIES:
        model = sentence_pieces(path).model
        tokens = []
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                tokens.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                tokens.append(b"")  # not part of any text
            else:
                tokens.append(name.replace(MARK, " ").encode())
        _VOCABULARIES[path] = Vocabulary(tokens)
    return _VOCABULARIES[path]


def lockstep(
    a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, a_to: np.ndarray, b_from: np.ndarray, b_to: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A place, B place, cut) of all links: rows ``from`` to ``to`` of both sides are merged, all rows in step.

    ``a_ends`` and ``b_ends`` are byte offsets on one scale, so that both sides of a row end on the same byte.
    """
    live = (a_from < a_to) & (b_from < b_to)
    a, b, last = a_from[live], b_from[live], a_to[live]
    links: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(a):
        a_end, b_end = a_ends[a], b_ends[b]
        links.append((a, b, a_end == b_end))
        a, b = a + (a_end <= b_end), b + (b_end <= a_end)
        on = a < last  # both sides finish together
        if not on.all():
            a, b, last = a[on], b[on], last[on]
    if not links:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none.astype(bool)
    return tuple(np.concatenate(x) for x in zip(*links))


_NAMES: list[tuple[np.ndarray, np.ndarray]] = []


def _decimals(most: int) -> tuple[np.ndarray, np.ndarray]:
    """(characters, digits) of the numbers 0 to ``most`` or beyond: a row has zero bytes behind its digits, the last for a sign."""
    if not _NAMES or len(_NAMES[0][1]) <= most:
        names = np.arange(max(most + 1, 1 << 16)).astype("S")
        _NAMES[:] = [(np.pad(names.view(np.uint8).reshape(len(names), -1), ((0, 0), (0, 1))), np.char.str_len(names))]
    return _NAMES[0]


def group_digests(a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray, a_bounds, b_bounds) -> list[str]:
    """sha256 of ``a1,a2|b1;a3|b2,b3`` for each document; a cut stands at the last token of a group on its side."""
    a_last, b_last = np.flatnonzero(a_cut), np.flatnonzero(b_cut)  # groups are numbered alike on both sides
    a_sizes, b_sizes = (np.diff(x, prepend=-1) for x in (a_last, b_last))
    # a group's A ids stand before its B ids
    a_place = np.arange(len(a)) + np.repeat(np.cumsum(b_sizes) - b_sizes, a_sizes)
    b_place = np.arange(len(b)) + np.repeat(np.cumsum(a_sizes), b_sizes)
    ids = np.empty(len(a) + len(b), dtype=np.int64)
    ids[a_place], ids[b_place] = a, b
    names, digits = _decimals(int(ids.max(initial=0)))
    characters = names[ids]
    characters[:, -1] = ord(",")
    characters[a_place[a_last], -1], characters[b_place[b_last], -1] = ord("|"), ord(";")
    raw, bounds = characters.tobytes().translate(None, b"\0"), np.append([0], np.cumsum(digits[ids] + 1))
    # documents are contiguous on both sides
    places = bounds[np.asarray(a_bounds) + np.asarray(b_bounds)].tolist()
    return [hashlib.sha256(raw[s : e - 1]).hexdigest() if e > s else "" for s, e in zip(places, places[1:])]


def align_texts(texts: list[str], a_path: str, b_path: str):
    """(n_a, n_b, n_groups, n_links, digests, pairs, document of each pair, links of each pair) of a slice of texts.

    A pair is one number: the A id times the size of B's vocabulary plus the B id; a document's pairs ascend.
    """
    side = (encoder(a_path, True, True, KNOWN_PIECES), sentence_pieces(b_path))
    vocabulary = (byte_vocabulary(a_path), piece_vocabulary(b_path))
    raw = [(" " + t).encode() if t else b"" for t in texts]
    lengths = np.array([len(r) for r in raw], dtype=np.int64)
    text_bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
    n, encoded = len(texts), []
    fine = lengths > 0
    cuts = side[0].cut(texts, spaced=True)
    for own, names in zip(side, vocabulary):
        ids, ends = own.encode(texts, True, cuts)
        sizes = names.sizes[ids]
        of = np.repeat(np.arange(n), np.diff(ends, prepend=0))
        covered = np.bincount(of, sizes, n).astype(np.int64)
        same = covered == lengths
        if same.all():
            equal = names.joined(ids) == text_bytes
            same &= np.bincount(np.repeat(np.arange(n), lengths), ~equal, n) == 0
        else:  # lengths differ somewhere: compare one by one
            bounds = np.append([0], ends).tolist()
            same &= np.array([names.joined(ids[s:e]).tobytes() == r for s, e, r in zip(bounds, bounds[1:], raw)], dtype=bool)
        fine &= same
        encoded.append((ids, of, sizes))
    starts = np.cumsum(np.where(fine, lengths, 0)) - np.where(fine, lengths, 0)
    kept_bytes = text_bytes[np.repeat(fine, lengths)]
    sides = []
    for ids, of, sizes in encoded:
        keep = fine[of]
        ids, of = ids[keep].astype(np.int64), of[keep]
        sides.append((ids, of, np.cumsum(sizes[keep])))
    (a, a_of, a_ends), (b, b_of, b_ends) = sides
    counts = [np.bincount(x, minlength=n) for x in (a_of, b_of)]
    heads = _entries(kept_bytes, starts[fine], a_ends, b_ends)
    a_from, b_from = (np.searchsorted(e, heads, side="right") for e in (a_ends, b_ends))
    a_at, b_at, cut = lockstep(a_ends, b_ends, a_from, np.append(a_from[1:], len(a)), b_from, np.append(b_from[1:], len(b)))
    a_cut, b_cut = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    a_cut[a_at[cut]] = b_cut[b_at[cut]] = True
    bounds = [np.append([0], np.cumsum(c)) for c in counts]
    digests = group_digests(a, b, a_cut, b_cut, *bounds)
    width = len(vocabulary[1].sizes)
    if len(vocabulary[0].sizes) * width > 1 << 32:
        raise ValueError("pairs of ids of these vocabularies don't fit 32 bits")
    # document and pair as one number
    every = np.sort((a_of[a_at] << 32) | (a[a_at] * width + b[b_at]))
    new = np.flatnonzero(np.diff(every, prepend=-1))
    links = np.diff(np.append(new, len(every)))
    code, document = every[new] & 0xFFFFFFFF, every[new] >> 32
    return (
        *counts, np.bincount(a_of, a_cut, n).astype(np.int64), np.bincount(document, links, n).astype(np.int64),
        digests, code, document, links,
    )


def _entries(text: np.ndarray, starts: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """Byte offsets at which the state vector enters: text starts and every ``FRAGMENT_WORDS``-th shared word start."""
    spaces = np.flatnonzero((text[:-1] == 32) & (text[1:] > 32)) if len(text) > 1 else np.zeros(0, np.int64)
    shared = np.zeros(len(text) + 1, dtype=np.int8)
    shared[a_ends] += 1
    shared[b_ends] += 1
    spaces = spaces[shared[spaces] == 2][::FRAGMENT_WORDS]
    return np.union1d(starts, spaces).astype(np.int64)


BLOCK = "block long, ids binary, missing binary, n_a binary, n_b binary, n_groups binary, n_links binary, digests binary, pairs binary, documents binary, links binary"


def blocks(docs: DataFrame, a_path: str, b_path: str, *, id_col: str, text_col: str) -> DataFrame:
    """One row per block of documents with their counts, digests and links; written once."""
    small_batches(docs.sparkSession)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in merged(batches, SLICE_CHARS):
            for rows, texts in sliced(batch, "text", SLICE_CHARS):
                *counts, digests, pairs, document, links = align_texts(texts, a_path, b_path)
                ids = rows.column("id")
                missing, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
                # a slice is encoded at once and kept in smaller blocks
                start = np.cumsum([0, *map(len, texts)])
                firsts = np.flatnonzero(np.diff(start[:-1] // BLOCK_CHARS, prepend=-1)).tolist()
                for i, j in zip(firsts, [*firsts[1:], len(texts)]):
                    p, q = np.searchsorted(document, [i, j])
                    arrays = [
                        ids[i:j].astype("<i8"), missing[i:j], *(x[i:j].astype("<i8") for x in counts),
                        np.frombuffer("".join(d.ljust(64) for d in digests[i:j]).encode(), dtype=np.uint8),
                        pairs[p:q].astype("<i8"), (document[p:q] - i).astype("<i4"), links[p:q].astype("<i4"),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], type=pa.int64()), *[pa.array([x.tobytes()], type=pa.binary()) for x in arrays]],
                        [c.split()[0] for c in BLOCK.split(", ")],
                    )
                    number += 1

    return written(named(docs, [id_col, text_col]).toDF("id", "text").mapInArrow(align, BLOCK), "aligned")


def pair_counts(table: DataFrame, width: int) -> DataFrame:
    """(block, pair, n, best): each block's distinct pairs with the documents that hold them, over all blocks, and
    whether no pair of the same A id has more."""

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, pairs in zip(batch.column("block").to_pylist(), batch.column("pairs").to_pylist()):
                pair, n = np.unique(np.frombuffer(pairs, dtype="<i8"), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block)), pa.array(pair), pa.array(n)], ["block", "pair", "n"])

    own = written(table.select("block", "pairs").mapInArrow(distinct, "block long, pair long, n long"), "block-pairs")
    counts = own.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.floor(F.col("pair") / F.lit(width)))
    counts = written(counts, "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))  # one row for each id of A
    judged = counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return own.select("block", "pair").join(judged, "pair")


def aligned_documents(
    docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(<id>, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    table = blocks(docs, a_path, b_path, id_col=id_col, text_col=text_col)
    width = len(piece_vocabulary(b_path).sizes)
    # a block holds a bounded number of characters, and so of pairs
    facts = pair_counts(table, width).groupBy("block").agg(F.collect_list(F.struct("pair", "n", "best")).alias("facts"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_py(), dtype=kind)
                pairs, document, links = get("pairs", "<i8"), get("documents", "<i4"), get("links", "<i4").astype(np.int64)
                n = len(get("ids", "<i8"))
                best = total = np.zeros(n, dtype=np.int64)
                if len(pairs):
                    known = batch.column("facts")[i].values
                    pair, count, top = (known.field(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best"))
                    order = np.argsort(pair)
                    at = order[np.searchsorted(pair, pairs, sorter=order)]
                    best = np.bincount(document, links * top[at], n).astype(np.int64)
                    total = np.bincount(document, links * count[at], n).astype(np.int64)
                digests = get("digests", "S64").astype(str)
                ids = pa.array(get("ids", "<i8"), mask=get("missing", bool))
                columns = [ids, *[pa.array(get(c, "<i8")) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(best), pa.array(total)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array([d.strip() for d in digests], type=pa.string())],
                    [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    schema = f"`{id_col}` long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return table.join(facts, "block", "left").mapInArrow(finish, schema)
