"""Token ids of whole texts by the tokenizers library, with words encoded once.

Both vocabularies split a text before any merge, and no token crosses a space that stands before
a visible character: it always begins a new piece (byte-level files) or is dropped (word files). The same
holds for a line break between visible characters. A text cut there gives pieces that encode on their own, and
their ids in order are the ids of the text. Arrow makes the cuts for a slice of texts at once and looks its distinct
pieces up in the worker's bounded table; what is new is encoded, words of Latin letters several to a text; numpy
puts the ids together. Texts with other white space beside a space or line break go the same way with fewer cuts.

Both kinds divide letters from signs, so a Latin word with signs behind it uses the one entry of its bare word, and
every run of signs an entry of its own. Word files may fold capitals too; then all spellings share the entry.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from earmark.llm.common import kept

# a space before a visible character; other spaces stay with the piece before them
CUT = re.compile(r" (?=\S)")
# stands for a line break at the start of a piece
BREAK = "\ue001"
# a word of Latin letters, its letters, and the signs that are divided from it; an apostrophe may begin a suffix
BARE = "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"
BARE_LINES = f"^{BREAK}?{BARE[1:]}"
LETTERS = "".join(c for c in map(chr, range(256)) if re.match(BARE, c))
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# byte-level files: stands before signs behind a word, which are no piece of their own; no piece holds it
BEHIND = " "
# white space of any alphabet (and the signs that Python takes for it)
SPACE = r"[\s\x{b}\x{1c}-\x{1f}\x{85}\pZ]"
# entries of the table, bytes of their names and their ids
MAX_PIECES = 700_000
MAX_NAME_BYTES = 24_000_000
MAX_PIECE_IDS = 16_000_000
# new words that share one text when they are encoded
SHARED_WORDS = 50


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs ``values[start : start + size]`` one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


def strings(array: pa.Array) -> list[str]:
    """Python strings of an array without nulls; quicker than one scalar after another."""
    return array.to_numpy(zero_copy_only=False).tolist()


class PieceTable:
    """Entries and their ids, names in one Arrow array; at the limit the half not used for longest goes."""

    def __init__(self, limit: int = MAX_PIECES):
        self.limit = limit
        self.names = pa.array([], type=pa.large_string())
        self.values = np.zeros(0, dtype="<u4")
        self.starts = self.sizes = self.stamps = np.zeros(0, dtype=np.int64)
        self.clock = 0

    @property
    def index(self) -> list[str]:
        """The names in the order of their places."""
        return strings(self.names)

    def places(self, names: pa.Array) -> np.ndarray:
        """Place of each name, -1 where it is unknown."""
        at = pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.stamps[at[at >= 0]] = self.clock
        return at

    def add(self, names: pa.Array, values: np.ndarray, sizes: np.ndarray) -> None:
        ends = len(self.values) + np.cumsum(sizes)
        self.names = pa.concat_arrays([self.names, names])
        self.values = np.concatenate([self.values, values])
        self.starts = np.concatenate([self.starts, ends - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.stamps = np.concatenate([self.stamps, np.full(len(sizes), self.clock)])

    def trim(self) -> None:
        self.clock += 1
        n = len(self.sizes)
        if n <= self.limit and self.names.nbytes <= MAX_NAME_BYTES and len(self.values) <= MAX_PIECE_IDS:
            return
        keep = np.sort(np.argsort(self.stamps, kind="stable")[n // 2 :])
        self.names = self.names.take(pa.array(keep))
        self.values = gather(self.values, self.starts[keep], self.sizes[keep])
        self.sizes, self.stamps = self.sizes[keep], self.stamps[keep]
        self.starts = np.cumsum(self.sizes) - self.sizes


@dataclass
class Cuts:
    """Code of each piece, pieces of each text, text of each piece, texts that go the other way, codes in use, the
    distinct entries of those, the first entry of each, which have signs behind a word, and the entries of these signs."""

    codes: np.ndarray
    sizes: np.ndarray
    of: np.ndarray
    whole: np.ndarray
    use: np.ndarray
    entries: pa.Array
    first: np.ndarray
    signed: np.ndarray
    behind: np.ndarray


class PieceEncoder:
    """``encode(texts)``: ids of all texts in a row and the end of each; ``ids_of(texts)``: the ids of each as bytes.

    ``space_counts`` says that a piece takes the space before it along (byte-level vocabularies);
    ``plain_specials`` that the strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, space_counts: bool, plain_specials: bool = False, limit: int = MAX_PIECES):
        self.lead = " " if space_counts else ""
        self.bare = BARE_LINES if space_counts else BARE
        self.folds = False
        self.signs = SIGNS
        self._load(path, plain_specials)
        self.table = PieceTable(limit)

    def _load(self, path: str, plain_specials: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = plain_specials
        self.folds = "Lowercase" in str(self.tokenizer.normalizer)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        # tokens that begin a word (byte-level) or end it (word files)
        self.edge = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, dtype=bool)
        self.edge[[i for t, i in vocab.items() if (t.startswith("Ġ") if self.lead else t.endswith("</w>"))]] = True
        self.line = vocab.get("Ċ", -1)
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if not plain_specials and any(re.fullmatch(f"[{LETTERS}]+[{re.escape(SIGNS)}]+", t) for t in specials):
            self.signs = ""  # a special token may reach from a word into the signs behind it

    def _raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _raw_signs(self, signs: list[str]) -> list[np.ndarray]:
        """Ids of signs behind a word."""
        return self._raw(signs)

    def _raw_pieces(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of single pieces: with the space before them, or with the line break."""
        return self._raw([self._text(p) for p in pieces])

    def _text(self, piece: str) -> str:
        return "\n" + piece[1:] if self.lead and piece[:1] == BREAK else self.lead + piece

    def _shared(self, words: list[str], lines: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of words of Latin letters, several to a text, cut where a word begins (or ends)."""
        between = "\n" if lines else " "
        texts = [between + between.join(words[i : i + SHARED_WORDS]) for i in range(0, len(words), SHARED_WORDS)]
        ids = np.concatenate([np.zeros(0, dtype="<u4"), *self._raw(texts)])
        at = np.flatnonzero(ids == self.line if lines else self.edge[ids])
        if len(at) != len(words):
            raise ValueError("words of letters did not keep to the vocabulary's division")
        return ids, np.diff(np.append(at, len(ids))) if self.lead else np.diff(np.concatenate([[-1], at]))

    def _learn(self, fresh: pa.Array) -> np.ndarray:
        """Places of new entries, which are encoded and added."""
        bare, line = pc.match_substring_regex(fresh, self.bare), pc.starts_with(fresh, BREAK)
        behind = pc.starts_with(fresh, BEHIND)
        odd = pc.invert(pc.or_(bare, behind))
        places, names, values, sizes, n = np.zeros(len(fresh), dtype=np.int64), [], [], [], len(self.table.sizes)
        for kind in (pc.and_not(bare, line), pc.and_(bare, line), odd, behind):
            names.append(fresh.filter(kind))
            own = strings(names[-1])
            if not own:
                continue
            places[kind.to_numpy(zero_copy_only=False)] = np.arange(n, n + len(own))
            n += len(own)
            if kind is odd or kind is behind:
                ids = self._raw_pieces(own) if kind is odd else self._raw_signs([s[1:] for s in own])
                values += ids
                sizes.append(np.array([len(x) for x in ids], dtype=np.int64))
            else:
                lines = own[0][0] == BREAK
                ids, lengths = self._shared([s[1:] for s in own] if lines else own, lines)
                values.append(ids)
                sizes.append(lengths)
        self.table.add(pa.concat_arrays(names), np.concatenate(values), np.concatenate(sizes))
        return places

    def _places(self, entries: pa.Array) -> np.ndarray:
        """Places of distinct entries in the table; new ones are encoded."""
        at = self.table.places(entries)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._learn(entries.take(pa.array(new)))
        return at

    def _known(self, cuts: Cuts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, starts, sizes) of distinct pieces: of their first entry and of the signs behind a word."""
        at, table = self._places(cuts.entries), self.table
        parts = np.zeros((len(cuts.first), 2, 2), dtype=np.int64)  # of each piece: word and signs, start and size
        for i, (rows, own) in enumerate([(slice(None), at[cuts.first]), (cuts.signed, at[cuts.behind])]):
            parts[rows, i] = np.stack([table.starts[own], table.sizes[own]], axis=1)
        sizes = parts[:, :, 1].sum(axis=1)
        return gather(table.values, parts[:, :, 0].ravel(), parts[:, :, 1].ravel()), np.cumsum(sizes) - sizes, sizes

    def _whole(self, text: str) -> np.ndarray:
        """Ids of a text with other white space: cut at spaces before visible characters only."""
        first, *rest = CUT.split(text)
        codes = {p: i for i, p in enumerate(dict.fromkeys([first, *[self.lead + p for p in rest]]))}
        ids = self._raw(list(codes))
        return np.concatenate([ids[codes[first]], *[ids[codes[self.lead + p]] for p in rest]])

    def _pieces(self, texts: list[str], spaced: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pieces, code of each piece, pieces of each text, texts that go the other way)."""
        if not self.lead:
            broken = [t.replace("\n", " ") for t in texts]
        else:
            head = "" if spaced else BREAK
            broken = [head + t.replace("\n", " " + BREAK) for t in texts]
        lists = pc.split_pattern(pa.array(broken, type=pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        codes = coded.indices.to_numpy(zero_copy_only=False)
        whole = np.zeros(len(texts), dtype=bool)
        if self.lead:
            # white space (of any alphabet) at an end of a piece, no character at all, or the sign itself inside
            misfit = pc.match_substring_regex(coded.dictionary, f"^{BREAK}?({SPACE}|$)|{SPACE}$|.{BREAK}")
            misfit = misfit.to_numpy(zero_copy_only=False)
            if misfit.any():
                whole[np.repeat(np.arange(len(texts)), sizes)[misfit[codes]]] = True
            whole |= np.array([BREAK in t for t in texts], dtype=bool)
        return coded.dictionary, codes, sizes, whole

    def cut(self, texts: list[str], spaced: bool = False) -> Cuts:
        """The pieces of the texts, which encoders of the same kind may share."""
        distinct, codes, sizes, whole = self._pieces(texts, spaced)
        of = np.repeat(np.arange(len(texts)), sizes)
        use = np.zeros(len(distinct), dtype=bool)
        use[codes[~whole[of]]] = True
        return Cuts(codes, sizes, of, whole, use, *self._divided(distinct.filter(pa.array(use))))

    def _divided(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct entries, first entry of each piece, pieces of a word and signs, entries of these signs)."""
        stems = pc.utf8_rtrim(pieces, characters=self.signs)
        latin = pc.match_substring_regex(stems, self.bare)
        signed = pc.and_(latin, pc.less(pc.binary_length(stems), pc.binary_length(pieces)))
        behind = pc.utf8_ltrim(pieces.filter(signed), characters=LETTERS + BREAK)
        if self.lead:
            behind = pc.binary_join_element_wise(pa.scalar(BEHIND, pieces.type), behind, pa.scalar("", pieces.type))
        stems = pc.if_else(latin, pc.utf8_lower(stems) if self.folds else stems, pieces)
        coded = pa.concat_arrays([stems, behind]).dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        return coded.dictionary, at[: len(pieces)], signed.to_numpy(zero_copy_only=False), at[len(pieces) :]

    def encode(self, texts: list[str], spaced: bool = False, cuts: Cuts | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): unsigned 32-bit ids of all texts and where each text's ids end. ``spaced`` puts a space
        before each text that isn't empty."""
        if not texts:
            return np.zeros(0, dtype="<u4"), np.zeros(0, dtype=np.int64)
        cuts = cuts or self.cut(texts, spaced)
        codes, sizes, of, whole, use = cuts.codes, cuts.sizes, cuts.of, cuts.whole, cuts.use
        self.table.trim()
        values, own_starts, own_sizes = self._known(cuts)
        places = np.zeros((2, len(use)), dtype=np.int64)
        places[:, use] = own_starts, own_sizes
        starts, taken = places[0][codes], places[1][codes]  # nothing of texts that go the other way
        taken[whole[of]] = 0
        if self.lead and not spaced:  # the break put before each text is no part of it
            heads = (np.cumsum(sizes) - sizes)[~whole]
            starts[heads] += 1
            taken[heads] -= 1
        counts = np.bincount(of, taken, len(texts)).astype(np.int64)
        ids = gather(values, starts, taken)
        if whole.any():
            bounds, parts, done = np.cumsum(counts) - counts, [], 0
            for i in np.flatnonzero(whole):
                own = self._whole((" " if spaced else "") + texts[i]) if texts[i] else ids[:0]
                parts += [ids[done : bounds[i]], own]
                done, counts[i] = bounds[i], len(own)
            ids = np.concatenate([*parts, ids[done:]])
        return ids, np.cumsum(counts)

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids as bytes, one entry per text."""
        ids, ends = self.encode(texts)
        raw, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


def encoder(path: str, space_counts: bool, plain_specials: bool = False, limit: int = MAX_PIECES) -> PieceEncoder:
    """The worker's encoder for a tokenizer file, loaded once; its table keeps ``limit`` pieces."""
    key = (path, space_counts, plain_specials, limit)
    held = kept("pieces", dict)
    if key not in held:
        held[key] = PieceEncoder(*key)
    return held[key]
