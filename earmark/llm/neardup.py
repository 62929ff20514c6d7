"""Near-duplicate components by b-bit MinHash.

1. Every text becomes the set of its hashed word shingles. Equal sets are one class from here on, so a
   group of copies of any size is one node.
2. A class keeps 128 minima. Bands of full minima give buckets of candidates; of each minimum only the low
   four bits are kept, packed into eight longs (four bit planes of 128 lanes).
3. Inside a bucket, leaders are compared with all members of other components: the join condition
   counts equal lanes with ``bit_count``, corrects for chance collisions, and lets through only pairs that may
   reach the similarity. A second count is a strict bound: each shingle flips one bit of a parity word, so two words
   differ in no more bits than the sets differ in shingles. Pairs that pass are confirmed on the full sets.
4. Confirmed links join components. The first leaders are the members that share most buckets. The next round takes
   more leaders from the members outside a bucket's largest component, until every bucket holds one component or every
   pair in it was compared. So no pair of a bucket is lost, and a group of near copies costs a few stars, not all its pairs.

Two texts at the similarity share no bucket with a probability below ``MISS``, and the lane count is five
standard deviations wide; the rest is exact (sets are compared by 48-bit hashes).

Defined results: a text without words has no shingles and is linked with nothing; a text of fewer words than a
shingle has one shingle, its whole sequence; repeated rows are copies and each gets its row; rows of one id stay
separate documents of that id; a component of null ids only has the id null; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType

from earmark.llm.common import kept, named, sliced, small_batches, written

LANES, BITS = 128, 4
PARITY_BITS = 1024
MISS = 1e-6
SEED = 3
# leaders that a bucket takes in round r: one, then FACTOR ** r
FACTOR = 16
# turns after which leaders outnumber the members of any bucket
MAX_TURNS = 15
MAX_WORDS = 200_000
LOWER_AND_SPACE = bytes(
    32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_rng = np.random.default_rng(SEED)
FACTORS = _rng.integers(0, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 1 << 63, LANES, dtype=np.uint64)
BAND_FACTORS = _rng.integers(0, 1 << 63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


def bands_for(similarity: float) -> tuple[int, int]:
    """(rows, bands): the longest bands that miss a pair at the similarity with a chance below MISS."""
    for rows in range(12, 1, -1):
        bands = LANES // rows
        if (1 - similarity**rows) ** bands <= MISS:
            return rows, bands
    return 1, LANES


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; words are lower-cased in A-Z and cut at ASCII white space."""
    own = text.encode().translate(LOWER_AND_SPACE).split()
    if not own:
        return np.zeros(0, np.uint64)
    known = kept("shingles", dict)
    if len(known) > MAX_WORDS:
        known.clear()
    for w in set(own).difference(known):
        known[w] = xxhash.xxh64_intdigest(w).to_bytes(8, "little")
    hashes = np.frombuffer(b"".join(map(known.__getitem__, own)), dtype="<u8")
    n = min(words, len(own))
    rolled = np.full(len(own) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        rolled = rolled * STEP + hashes[i : len(own) - n + 1 + i]
    return np.unique(_mixed(rolled))


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(LANES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 512):
        part = hashes[i : i + 512, None] * FACTORS + SHIFTS
        np.minimum(out, part.min(axis=0), out=out)
    return _mixed(out)


def planes(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima: for each bit two longs of 64 lanes."""
    bits = (least[None, :] >> np.arange(BITS, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), axis=1).view("<i8").reshape(-1)


def parity(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of 1024 groups of hashes, set when the group has an odd number of them."""
    odd = np.bincount((hashes >> np.uint64(20)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view("<i8")


def signed(docs: DataFrame, words: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, cid, planes, parity, buckets) of every document; cid names the set, null for an empty one."""
    rows, bands = bands_for(similarity)
    kind = docs.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(bands, dtype=np.uint64) * STEP
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                n, cid, low, odd, buckets = [], [], [], [], []
                for text in texts:
                    own = shingles(text, words)
                    n.append(len(own))
                    if not len(own):
                        cid.append(None)
                        low.append(None)
                        odd.append(None)
                        buckets.append(None)
                        continue
                    least = minima(own)
                    weighted = (least * BAND_FACTORS)[: rows * bands].reshape(bands, rows).sum(axis=1, dtype=np.uint64)
                    cid.append(xxhash.xxh128_digest(own.tobytes()))
                    low.append(planes(least))
                    odd.append(parity(own))
                    buckets.append(_mixed(weighted + salt).view(np.int64))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), pa.array(n, type=pa.int64()), pa.array(cid, type=pa.binary()),
                        pa.array(low, type=longs), pa.array(odd, type=longs), pa.array(buckets, type=longs),
                    ],
                    ["id", "n_shingles", "cid", "planes", "parity", "buckets"],
                )

    schema = f"id {kind}, n_shingles long, cid binary, planes array<long>, parity array<long>, buckets array<long>"
    return named(docs, [id_col, text_col]).toDF("id", "text").mapInArrow(sign, schema)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """(cid, hashes) of (text) rows: the sorted hashes, 48 bits each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in sliced(batch, "text"):
                cid, hashes = [], []
                for text in texts:
                    own = shingles(text, words)
                    cid.append(xxhash.xxh128_digest(own.tobytes()))
                    hashes.append(own.view(np.uint8).reshape(-1, 8)[:, 2:].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid, type=pa.binary()), pa.array(hashes, type=pa.binary())], ["cid", "hashes"]
                )

    return docs.select("text").mapInArrow(sets, "cid binary, hashes binary")


@F.arrow_udf(LongType())
def common_hashes(a: pa.Array, b: pa.Array) -> pa.Array:
    """Sizes of the intersections of two sets of 48-bit hashes."""

    def numbers(raw: bytes) -> np.ndarray:
        wide = np.zeros((len(raw) // 6, 8), dtype=np.uint8)
        wide[:, :6] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 6)
        return wide.view("<u8").reshape(-1)

    out = [
        len(np.intersect1d(numbers(x), numbers(y), assume_unique=True)) for x, y in zip(a.to_pylist(), b.to_pylist())
    ]
    return pa.array(out, type=pa.int64())


def equal_lanes(a: Column, b: Column) -> Column:
    """Lanes in which two signatures agree in all kept bits."""
    differ = []
    for half in range(LANES // 64):
        bits = [a[2 * i + half].bitwiseXOR(b[2 * i + half]) for i in range(BITS)]
        any_bit = bits[0]
        for x in bits[1:]:
            any_bit = any_bit.bitwiseOR(x)
        differ.append(F.bit_count(any_bit))
    return F.lit(LANES) - sum(differ[1:], differ[0])


def differing_bits(a: Column, b: Column) -> Column:
    """Bits in which two parity words differ: never more than the sets differ in shingles."""
    counts = [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(PARITY_BITS // 64)]
    return sum(counts[1:], counts[0])


def least_lanes(similarity: float) -> int:
    """Equal lanes below which a pair at the similarity lies with five standard deviations."""
    low = max(0.0, similarity - 5 * math.sqrt(similarity * (1 - similarity) / LANES))
    chance = 2.0**-BITS
    return math.floor(LANES * (chance + (1 - chance) * low))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for links (a, b).

    Large and small stars in turn: every pass hangs nodes on smaller neighbours until nothing moves;
    the number of passes grows with the logarithm of the number of nodes.
    """
    spark = links.sparkSession
    stars = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())

    before = state(stars)
    while before[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")), "least")
        large = written(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        after = state(stars)
        if after == before:
            break
        before = after
    if not before[0]:
        return spark.createDataFrame([], "node binary, root binary")
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _renamed(table: DataFrame, column: str, roots: DataFrame) -> DataFrame:
    """``column`` replaced by its root where it has one."""
    named_roots = roots.select(F.col("node").alias(column), F.col("root").alias("_root"))
    return table.join(named_roots, column, "left").withColumn(column, F.coalesce("_root", column)).drop("_root")


def near_duplicates(
    docs: DataFrame, *, words: int = 5, similarity: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(<id>, n_shingles, component_id, kept) of every document.

    Documents are linked when 100 * |common| >= similarity * |union| of their shingle sets; ``component_id`` is the
    smallest id that links reach, ``kept`` says that it is the document's own.
    """
    small_batches(docs.sparkSession)
    share = similarity / 100
    sets = written(signed(docs, words, share, id_col, text_col), "signed")
    classes = written(
        sets.filter("cid IS NOT NULL").groupBy("cid").agg(
            F.min("id").alias("id"), F.first("n_shingles").alias("n"),
            F.first("planes").alias("planes"), F.first("parity").alias("parity"), F.first("buckets").alias("buckets"),
        ),
        "classes",
    )

    # buckets with more than one class
    placed = classes.select("cid", F.explode("buckets").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count("*").alias("_n")).filter("_n > 1")
    met = written(placed.join(shared, "bucket"), "met")
    weights = met.groupBy("cid").agg(F.sum("_n").alias("weight"))
    met_classes = written(
        classes.join(weights, "cid").select("cid", "id", "n", "planes", "parity", "weight"), "met-classes"
    )
    members = written(
        met.select("bucket", "cid").join(met_classes.drop("id"), "cid").withColumn("comp", F.col("cid")), "members"
    )
    # full sets of the classes in them; a class is read from the documents of its smallest id
    wanted = met_classes.select(F.col("id").alias("wanted_id")).distinct()
    texts = named(docs, [id_col, text_col]).toDF("id", "text").filter("text IS NOT NULL")
    # a merge join at every size: the ids wanted grow with the corpus
    texts = texts.join(wanted.hint("merge"), F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")
    full = written(shingle_sets(texts, words), "sets")
    if full.count() > met_classes.count():  # ids repeat: copies of a set would multiply in the joins below
        full = written(full.join(met_classes.select("cid").hint("merge"), "cid", "left_semi").dropDuplicates(["cid"]), "sets")

    roots = classes.select("cid", F.col("cid").alias("comp"))
    most = least_lanes(share)
    for turn in range(MAX_TURNS):
        counted = members.groupBy("bucket", "comp").agg(F.count("*").alias("n_comp"), F.min(-F.col("weight")).alias("weight"))
        mixed = counted.groupBy("bucket").agg(
            F.max_by("comp", F.struct("n_comp", "weight", "comp")).alias("largest"), F.count("*").alias("n_comps")
        )
        mixed = written(mixed.filter("n_comps > 1").select("bucket", "largest"), "mixed")
        if mixed.isEmpty():
            break
        open_members = members.join(mixed, "bucket")
        outside = Window.partitionBy("bucket").orderBy(F.desc("weight"), "cid")
        leaders = (
            open_members.filter("comp <> largest")
            .withColumn("_turn", F.row_number().over(outside))
            .filter(F.col("_turn") <= FACTOR**turn)
            .select(
                F.col("bucket").alias("l_bucket"), F.col("cid").alias("l_cid"), F.col("n").alias("l_n"),
                F.col("planes").alias("l_planes"), F.col("parity").alias("l_parity"), F.col("comp").alias("l_comp"),
            )
        )
        leaders = written(leaders, "leaders")
        near = (
            (F.col("comp") != F.col("l_comp"))
            & (F.least("n", "l_n") * 100 >= F.greatest("n", "l_n") * similarity)
            & (equal_lanes(F.col("planes"), F.col("l_planes")) >= most)
            # 100 * common >= similarity * union, in terms of the difference of the sets
            & (differing_bits(F.col("parity"), F.col("l_parity")) * (100 + similarity) <= (F.col("n") + F.col("l_n")) * (100 - similarity))
        )
        pairs = (
            members.join(leaders, (F.col("bucket") == F.col("l_bucket")) & near)
            .select("cid", "l_cid", "n", "l_n", "comp", "l_comp").distinct()
        )
        pairs = written(pairs, "pairs")
        left = full.select(F.col("cid"), F.col("hashes").alias("h"))
        right = full.select(F.col("cid").alias("l_cid"), F.col("hashes").alias("l_h"))
        common = common_hashes("h", "l_h")
        confirmed = (
            pairs.join(left, "cid").join(right, "l_cid").withColumn("common", common)
            .filter(F.col("common") * 100 >= (F.col("n") + F.col("l_n") - F.col("common")) * similarity)
        )
        links = confirmed.select(F.col("comp").alias("a"), F.col("l_comp").alias("b"))
        joined = components(links)
        rest = open_members.join(
            leaders.select(F.col("l_bucket").alias("bucket"), F.col("l_cid").alias("cid")), ["bucket", "cid"], "left_anti"
        ).drop("largest")
        members = written(_renamed(rest, "comp", joined), "members")
        roots = written(_renamed(roots, "comp", joined), "roots")
    else:
        raise RuntimeError("buckets are still mixed after all turns")

    ids = classes.select("cid", "id").join(roots, "cid")
    smallest = written(ids.groupBy("comp").agg(F.min("id").alias("component_id")), "smallest")
    named_classes = written(ids.join(smallest, "comp").select("cid", "component_id"), "named")
    out = sets.select("id", "n_shingles", "cid").join(named_classes, "cid", "left")
    component = F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
