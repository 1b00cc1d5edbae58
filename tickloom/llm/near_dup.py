"""Near copies of whole texts: circulant MinHash, banding, exact Jaccard, components.

1. Every text becomes the set of its word shingles, as 64-bit hashes. Equal sets are one class.
2. The signature of a class takes two permutations of a universe of 2^20 places: the first one
   scatters the shingles, the second one, shifted by k places on the circle, gives coordinate k.
   The shifted values of a shingle lie side by side in one table, so a signature is the minimum of
   table rows.
3. Classes that agree on a band meet in a bucket. In two rounds, the first over a few bands, every
   class is compared with one bucket leader: the signatures, and if these agree well enough the full
   sets. The links give components.
4. Buckets that still hold several components are worked through in blocks: first the signatures, then
   the full sets of all classes that have a similar signature from another component in their block. So no
   pair that meets in a bucket is left open, a large group of copies costs one comparison a member, and no
   list of pairs is made.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import or_empty, text_rows, written

BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
UNIVERSE_BITS = 20
#: Bands of the first round.
FIRST_BANDS = 4
#: Pairs in a block are looked at further if so many coordinates agree: six standard deviations
#: below what a pair at the threshold has.
AGREE = 97
#: Members compared with one copy of a leader's text; rows of a block.
MEMBERS, BLOCK = 256, 512
#: Shingles of a block, about.
BLOCK_SHINGLES = 1_000_000
#: Bits of the map of keys whose texts are wanted: 2 MB.
KEY_BITS = 1 << 24
SLICE = 1_000_000
U64 = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.random.default_rng(1).integers(1 << 63, size=256, dtype=U64) * U64(2) + U64(1)


@lru_cache(maxsize=1)
def _spaces() -> np.ndarray:
    out = np.zeros(256, bool)
    out[[32, 9, 10, 11, 12, 13]] = True
    return out


STEP = 0x5851F42D4C957F2D
BACK = pow(STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SLICE + 4096), base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * SLICE:
            _powers[base] = have
    return have[:n]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of lower-cased bytes begins, and its hash: a difference of running sums."""
    letters = np.frombuffer(raw, np.uint8)
    inside = ~_spaces()[letters]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    first, stop = edge[::2], edge[1::2]
    run = np.zeros(len(letters) + 1, U64)
    np.cumsum(_letters()[letters] * _power(STEP, len(letters)), out=run[1:])
    return first, _mix((run[stop] - run[first]) * _power(BACK, len(letters) + 1)[first] + (stop - first).astype(U64))


def _parts(raw: bytes) -> Iterator[bytes]:
    """A very long text in parts that end at white space."""
    at = 0
    while len(raw) - at > SLICE:
        stop = max(raw.rfind(s, at, at + SLICE) for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if stop <= at:  # one word longer than a part
            found = [p for s in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c") if (p := raw.find(s, at + SLICE)) >= 0]
            stop = min(found, default=len(raw))
        yield raw[at:stop]
        at = stop
    yield raw[at:]


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raws = [t.encode().lower() for t in texts]
    if any(len(r) > SLICE for r in raws):
        per_text = [np.concatenate([word_hashes(p)[1] for p in _parts(r)]) for r in raws]
        hashes = np.concatenate(per_text)
        ends = np.cumsum([len(h) for h in per_text])
    else:
        first, hashes = word_hashes(b" ".join(raws))
        ends = np.searchsorted(first, np.cumsum([len(r) + 1 for r in raws]) - 1)
    n = len(hashes)
    odd = [U64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
    rolled = np.zeros(max(0, n - words + 1), U64)
    for k in range(words):
        rolled = _mix(rolled + hashes[k : k + len(rolled)] * odd[k % 5] + U64(k))
    out, a = [], 0
    for b in ends.tolist():
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:  # fewer words: the whole sequence is one shingle
            out.append(np.frombuffer(hashlib.blake2b(hashes[a:b].tobytes(), digest_size=8).digest(), U64))
        else:
            out.append(np.empty(0, U64))
        a = b
    return out


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


@lru_cache(maxsize=1)
def _circle() -> np.ndarray:
    """The second permutation, with its beginning again at its end, seen through a sliding window."""
    table = np.random.default_rng(2).permutation(1 << UNIVERSE_BITS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[: COORDINATES - 1]]), COORDINATES)


def _scatter(shingles: np.ndarray) -> np.ndarray:
    """The first permutation: multiplications by odd numbers and folds, each a bijection of the universe."""
    mask = U64((1 << UNIVERSE_BITS) - 1)
    x = (shingles & mask) * U64(0x9E375) & mask
    x ^= x >> U64(11)
    x = x * U64(0x6A4D5) & mask
    return (x ^ (x >> U64(9))).astype(np.int64)


def signature(shingles: np.ndarray) -> np.ndarray:
    places, circle = _scatter(shingles), _circle()
    best = circle[places[:2048]].min(axis=0)
    for a in range(2048, len(places), 2048):
        best = np.minimum(best, circle[places[a : a + 2048]].min(axis=0))
    return best


def buckets_of() -> Column:
    """The bucket of each band of a signature."""
    each = 2 * ROWS
    return F.array(*[F.xxhash64(F.lit(k), F.substring("sig", 1 + each * k, each)) for k in range(BANDS)])


def sketches(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``id``, ``n`` (set size), ``cls`` (digest of the set), ``sig``; empty sets have NULL in the last two."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("cls", T.BinaryType()), T.StructField("sig", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        for batch in batches:
            for kept, texts in text_rows(batch, ["id"], "text", SLICE):
                sets = shingle_sets(texts, words)
                sigs = [signature(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        kept.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([None if s is None else s.astype(np.uint16).tobytes() for s in sigs], pa.binary()),
                    ],
                    schema.names,
                )

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _place(column: str) -> Column:
    return F.pmod(F.xxhash64(F.col(column)), F.lit(KEY_BITS)) + 1


def key_bits(keys: DataFrame, column: str) -> DataFrame:
    """A bitmap of the hashed keys, of a fixed size: ``bucket``, ``bits``."""
    held = keys.select(_place(column).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
    return written(held.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits")), "bits")


def among(rows: DataFrame, bits: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """The rows whose key may be one of those of the bitmap (``left_anti``: the rows whose key is none of them), without a shuffle."""
    place = _place(column)
    byte = F.conv(F.hex(F.substring("bits", (F.bitmap_bit_position(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.bit_get(byte, (F.bitmap_bit_position(place) % 8).cast("int")) == 1
    return rows.join(F.broadcast(bits), (F.bitmap_bucket_number(place) == F.col("bucket")) & is_set, how)


def with_texts(wanted: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``wanted`` (with ``id``) with the texts of the documents of that key, as ``text``.

    A bitmap of the keys goes to the documents first, so that hardly any texts but those wanted are shuffled.
    """
    texts = docs.select(F.col(key).cast("long").alias("id"), or_empty(text).alias("text"))
    found = among(texts, key_bits(wanted, "id"), "id")
    return wanted.join(found.select(F.col("id").alias("__id"), "text"), F.col("id").eqNullSafe(F.col("__id"))).drop("__id")


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """Those of the pairs (``a``, ``b``; class digests) whose full sets are alike enough.

    The text of one document of each class goes to where its pairs are. Rows of a leader ``a`` are
    dealt in runs of a bounded number of members, each with a copy of the leader's text.
    """
    runs = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("runs"))
    runs = written(runs, "leaders")
    members = pairs.join(runs, "a").select("a", F.expr("pmod(xxhash64(b), runs)").cast("int").alias("run"), F.col("b").alias("cls"), F.lit(1).alias("role"))
    leaders = runs.select("a", F.explode(F.sequence(F.lit(0), F.col("runs") - 1)).alias("run"), F.col("a").alias("cls"), F.lit(0).alias("role"))
    wanted = written(members.unionByName(leaders).join(classes.select("cls", "id"), "cls"), "wanted")
    held = with_texts(wanted, docs, key, text).select("a", "run", "cls", "role", "text")
    dealt = held.repartition("a", "run").sortWithinPartitions("a", "run", "role")
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        at, leader = None, None
        for batch in batches:
            for kept, batch_texts in text_rows(batch, ["a", "run", "cls", "role"], "text", SLICE):
                found_a, found_b = [], []
                for a, r, cls, role, s in zip(*[c.to_pylist() for c in kept.columns], shingle_sets(batch_texts, words), strict=True):
                    if digest(s) != cls:
                        continue  # another row under the same key
                    if role == 0:
                        at, leader = (a, r), s
                    elif at == (a, r) and alike(leader, s, percent):
                        found_a.append(a)
                        found_b.append(cls)
                yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.binary()), pa.array(found_b, pa.binary())], schema.names)

    return dealt.mapInArrow(run, schema).distinct()


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``root`` (the smallest node of its component) for every node that has an edge.

    Alternates two steps until nothing changes: every node hands its larger neighbours, then its
    smaller ones, to the smallest of them. The edges of each round are written out.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m")), "least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.where("u != v").distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.distinct(), "edges")
    return now.select("u", F.col("v").alias("root"))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, which has none itself."""
    if not edges.groupBy("u").count().where("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def _contracted(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: those of a graph whose nodes are the components so far."""
    if links.isEmpty():
        return roots
    named = links.join(roots.select(F.col("u").alias("a"), F.col("root").alias("x")), "a", "left").join(roots.select(F.col("u").alias("b"), F.col("root").alias("y")), "b", "left")
    joined = components(named.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    joined = joined.select(F.col("u").alias("root"), F.col("root").alias("above"))
    old = roots.join(joined, "root", "left").select("u", F.coalesce("above", "root").alias("root"))
    new = joined.select(F.col("root").alias("u"), F.col("above").alias("root")).join(roots, "u", "left_anti")
    return written(old.unionByName(new), "roots")


def _nearest(shared: DataFrame) -> DataFrame:
    """For each class the leader ``a`` of most of its buckets (``cls`` as ``b``)."""
    counted = shared.groupBy("a", "cls").agg(F.count("*").alias("n"))
    return counted.groupBy("cls").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", F.col("cls").alias("b"))


def _shared(classes: DataFrame) -> DataFrame:
    """``k``, ``band``, ``cls``, ``low``, ``n``: every class in each of its buckets that another class is in too."""
    rows = classes.select(F.posexplode(buckets_of()).alias("k", "band"), "cls", "low", "n")
    several = written(rows.groupBy("band").agg(F.count("*").alias("m")).where("m > 1").select("band"), "several")
    rows = among(rows, key_bits(several, "band"), "band")  # hardly any others are shuffled
    return written(rows.join(several, "band", "left_semi").select("k", "band", "cls", "low", "n"), "shared")


def _rooted(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``band``, ``cls``, ``low``, ``n``, ``root``: the classes in their buckets, with their component so far."""
    named = shared.join(roots, F.col("cls") == F.col("u"), "left")
    return named.select("band", "cls", "low", "n", F.coalesce("root", "cls").alias("root"))


def _mixed(rows: DataFrame) -> DataFrame:
    """Buckets with classes of several components: ``band``, the leader ``a`` and its component ``a_root``."""
    lead = F.min(F.struct("low", "cls", "root"))
    found = rows.groupBy("band").agg(lead.alias("lead"), F.min("root").alias("x"), F.max("root").alias("y")).where("x != y")
    return found.select("band", F.col("lead.cls").alias("a"), F.col("lead.root").alias("a_root"))


def _largest(rows: DataFrame) -> DataFrame:
    """For each bucket with several components: ``band`` and the component with most rows there (``most``)."""
    sizes = rows.groupBy("band", "root").agg(F.count("*").alias("k"))
    found = sizes.groupBy("band").agg(F.max_by("root", F.struct("k", "root")).alias("most"), F.count("*").alias("n")).where("n > 1")
    return written(found.select("band", "most"), "largest")


def _dealt(places: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows to compare in blocks of bounded size: a place (``of``, ``cls``, ``n``, ``root``, ``stay``, ``visit``) that stays is
    dealt to one block of its group ``of``, one that visits goes to all of them. Adds ``block``, ``side`` and ``sig``.

    A class brings its signature once, to all of its places; it has at most two a band and one more.
    """
    blocks = written(places.where("stay").groupBy("of").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")), "blocks")
    held = places.join(blocks, "of").groupBy("cls").agg(F.first("root").alias("root"), F.collect_list(F.struct("of", "blocks", "stay", "visit")).alias("places"))
    rows = held.join(classes.select("cls", "sig"), "cls").select("cls", "root", "sig", F.inline("places"))
    home = "if(stay, array(struct(int(pmod(xxhash64(cls), blocks)) AS block, 0 AS side)), array())"
    away = "if(visit, transform(sequence(0, blocks - 1), b -> struct(b AS block, 1 AS side)), array())"
    return rows.select("of", "cls", "root", "sig", F.expr(f"inline(concat({home}, {away}))"))


def _places(rows: DataFrame) -> DataFrame:
    """What is left open in buckets with several components.

    Members of a bucket outside its largest component meet one another in the bucket. They meet the
    largest component once, all of it, wherever they share a bucket with it; its own members need
    not be compared with one another, and do not go to their buckets again.
    """
    largest = _largest(rows)
    others = rows.alias("r").join(largest.alias("m"), (F.col("r.band") == F.col("m.band")) & (F.col("r.root") != F.col("m.most")))
    others = written(others.select(F.col("r.band").cast("string").cast("binary").alias("of"), "cls", "n", "root", "most"), "others")
    several = others.groupBy("of").count().where("count > 1").select("of")
    inside = others.join(several, "of", "left_semi").select("of", "cls", "n", "root")
    callers = others.select(F.col("most").alias("of"), "cls", "n", "root").distinct()
    members = rows.select(F.col("root").alias("of"), "cls", "n", "root").distinct().join(callers.select("of").distinct(), "of", "left_semi")
    sides = lambda df, stay, visit: df.withColumns({"stay": F.lit(stay), "visit": F.lit(visit)})
    return sides(inside, True, True).unionByName(sides(members, True, False)).unionByName(sides(callers, False, True))


def _star_places(stars: DataFrame) -> DataFrame:
    """Every ``b`` meets its leader ``a`` only."""
    members = stars.select(F.col("a").alias("of"), F.col("b").alias("cls"), F.lit(1).cast("long").alias("n"), F.col("b").alias("root"), F.lit(True).alias("stay"), F.lit(False).alias("visit"))
    leaders = stars.select(F.col("a").alias("of"), F.col("a").alias("cls"), F.lit(1).cast("long").alias("n"), F.col("a").alias("root"), F.lit(False).alias("stay"), F.lit(True).alias("visit"))
    return members.unionByName(leaders.distinct())


def _agreeing(places: DataFrame, classes: DataFrame, columns: list[str], types: list[pa.DataType], give: Callable[[tuple, list, list, np.ndarray, np.ndarray], list[tuple]]) -> DataFrame:
    """What ``give`` makes of each block: of its stays, some of its visits, and numbers of pairs of them (visit, stay) that lie
    in different components and have similar signatures."""
    dealt = _dealt(places, classes).repartition("of", "block").sortWithinPartitions("of", "block", "side")

    def compare(at: tuple, stay: list[tuple], visit: list[tuple]) -> list[tuple]:
        if not stay or not visit:
            return []
        sig = np.frombuffer(b"".join(s for _, s, _ in stay), np.uint16).reshape(len(stay), -1)
        roots = np.array([r for _, _, r in stay], object)
        pairs = [np.flatnonzero(((sig == np.frombuffer(s, np.uint16)).sum(axis=1) >= AGREE) & (roots != root)) for _, s, root in visit]
        at_visit = np.repeat(np.arange(len(visit)), [len(p) for p in pairs])
        return give(at, stay, visit, at_visit, np.concatenate(pairs)) if len(at_visit) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stay, visit = None, [], []
        found: set[tuple] = set()

        def out() -> pa.RecordBatch:
            held = list(zip(*sorted(found), strict=True)) or [[] for _ in columns]
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(held, types, strict=True)], columns)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                of, block, side, cls, sig, root = row
                if (of, block) != at:
                    found.update(compare(at, stay, visit))
                    at, stay, visit = (of, block), [], []
                    if len(found) > 10_000:
                        yield out()
                if side == 0:
                    stay.append((cls, sig, root))
                else:
                    visit.append((cls, sig, root))
                    if len(visit) >= BLOCK:  # visitors need not be held together
                        found.update(compare(at, stay, visit))
                        visit = []
        found.update(compare(at, stay, visit))
        yield out()

    schema = ", ".join(f"{c} {'int' if t == pa.int32() else t}" for c, t in zip(columns, types, strict=True))
    return dealt.select("of", "block", "side", "cls", "sig", "root").mapInArrow(run, schema).distinct()


def agreeing_stars(stars: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (the leader ``a``, ``b``) that have similar signatures."""
    return _agreeing(_star_places(stars), classes, ["a", "b"], [pa.binary(), pa.binary()], lambda at, stay, visit, v, s: [(visit[x][0], stay[y][0]) for x, y in zip(v.tolist(), s.tolist(), strict=True)])


def meetings(places: DataFrame, classes: DataFrame) -> DataFrame:
    """``of``, ``block``, ``side``, ``cls``, ``root``: who has a similar signature on the other side of a block.

    Not the pairs: in a group of texts that are alike, but not enough, these grow with the square of its size.
    """

    def give(at: tuple, stay: list, visit: list, v: np.ndarray, s: np.ndarray) -> list[tuple]:
        sides = ((0, stay, s), (1, visit, v))
        return [(*at, side, held[k][0], held[k][2]) for side, held, which in sides for k in np.unique(which).tolist()]

    return _agreeing(places, classes, ["of", "block", "side", "cls", "root"], [pa.binary(), pa.int32(), pa.int32(), pa.binary(), pa.binary()], give)


def common_counts(sets: list[np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    """A function that counts how many shingles a set has in common with each of the sets."""
    shingles = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(shingles, kind="stable")
    shingles, owner = shingles[order], owner[order]

    def count(one: np.ndarray) -> np.ndarray:
        first = np.searchsorted(shingles, one)
        sizes = np.searchsorted(shingles, one, "right") - first
        at = np.arange(sizes.sum()) + np.repeat(first - (sizes.cumsum() - sizes), sizes)
        return np.bincount(owner[at], minlength=len(sets))

    return count


def links(met: DataFrame, docs: DataFrame, classes: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    """Pairs of classes (``a``, ``b``) whose full sets are alike enough, as many as join what each block has in one component.

    The text of one document of each class goes to the blocks where it has met others, and is compared with all of the other side.
    """
    wanted = written(met.join(classes.select("cls", "id"), "cls"), "wanted")
    held = with_texts(wanted, docs, key, text).select("of", "block", "side", "cls", "root", "text")
    dealt = held.repartition("of", "block").sortWithinPartitions("of", "block", "side")
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        at, stay, count, above = None, {}, None, {}

        def top(root: bytes) -> bytes:
            while (up := above.get(root, root)) != root:
                above[root] = root = above.get(up, up)
            return root

        for batch in batches:
            for kept, batch_texts in text_rows(batch, ["of", "block", "side", "cls", "root"], "text", SLICE):
                found_a, found_b = [], []
                for of, block, side, cls, root, s in zip(*[c.to_pylist() for c in kept.columns], shingle_sets(batch_texts, words), strict=True):
                    if digest(s) != cls:
                        continue  # another row under the same key
                    if (of, block) != at:
                        at, stay, count, above = (of, block), {}, None, {}
                    if side == 0:
                        stay[cls] = (s, root)
                    elif stay:
                        if count is None:
                            count = common_counts([x for x, _ in stay.values()])
                            names, roots, sizes = list(stay), [r for _, r in stay.values()], np.array([len(x) for x, _ in stay.values()])
                        common = count(s)
                        for k in np.flatnonzero(100 * common >= percent * (len(s) + sizes - common)).tolist():
                            x, y = top(root), top(roots[k])
                            if x != y:
                                above[x] = y
                                found_a.append(min(cls, names[k]))
                                found_b.append(max(cls, names[k]))
                yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.binary()), pa.array(found_b, pa.binary())], schema.names)

    return dealt.mapInArrow(run, schema).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: ``key``, ``n_shingles``, ``component_id``, ``kept``.

    Words are split at ASCII white space after lower-casing A-Z. Two texts are linked if their sets
    of ``words``-word shingles have 100 * intersection >= percent * union; a shorter text is one
    shingle. ``component_id`` is the smallest key among the texts reachable over links. NULL texts
    and texts without a word have an empty set and are linked with nothing: their component is
    their own key. A NULL key counts as smaller than any other. Repeated rows are in one component.
    Missed links: a pair at the threshold shares no band with a probability of 3e-6, one at 0.9 of 1e-12.
    """
    sketch = written(sketches(docs, key, text, words), "sketches")
    low = F.coalesce(F.col("id"), F.lit(-(2**63)))
    classes = written(
        sketch.where("n > 0").groupBy("cls").agg(F.min(low).alias("low"), F.first("n").alias("n"), F.first("sig").alias("sig")).withColumn("id", F.expr("nullif(low, -9223372036854775808L)")),
        "classes",
    )
    shared = _shared(classes)
    # A first round over a few bands: every class with the bucket leader it shares most of them with.
    rows = shared.where(F.col("k") < FIRST_BANDS)
    buckets = written(rows.groupBy("band").agg(F.min(F.struct("low", "cls"))["cls"].alias("a")), "buckets")
    first = written(_nearest(rows.select("band", "cls").join(buckets, "band").where("a != cls")), "stars")
    alike_first = written(agreeing_stars(first, classes), "alike")
    roots = components(verified(alike_first, docs, classes, key, text, words, percent))
    # Then over all bands, for buckets whose members are not in one component yet: the classes that
    # are not in their leader's component, again with the leader they share most buckets with.
    rows = _rooted(shared, roots)
    mixed = written(_mixed(rows), "mixed")
    if not mixed.isEmpty():
        apart = rows.alias("r").join(mixed.alias("m"), (F.col("r.band") == F.col("m.band")) & (F.col("r.root") != F.col("m.a_root"))).select("a", "cls")
        second = written(_nearest(apart).join(first, ["a", "b"], "left_anti"), "stars")
        if not second.isEmpty():
            alike_second = written(agreeing_stars(second, classes), "alike")
            roots = _contracted(roots, written(verified(alike_second, docs, classes, key, text, words, percent), "links"))
            rows = _rooted(shared, roots)
        # What is left is compared in blocks.
        more = written(meetings(_places(rows), classes), "open")
        if not more.isEmpty():
            roots = _contracted(roots, written(links(more, docs, classes, key, text, words, percent), "links"))
    grouped = classes.select("cls", "low").join(roots, F.col("cls") == F.col("u"), "left").select("cls", "low", F.coalesce("root", "cls").alias("root"))
    grouped = written(grouped, "grouped")
    lowest = written(grouped.groupBy("root").agg(F.min("low").alias("component_low")), "lowest")
    final = written(grouped.join(lowest, "root").select("cls", "component_low"), "components")
    out = sketch.select("id", "n", "cls").join(final, "cls", "left")
    component = F.coalesce(F.col("component_low"), low)
    out = out.withColumn("component_id", F.when(component != F.lit(-(2**63)), component))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of the smallest key of each component, with all columns; of rows with equal key and text one stays.

    Two bitmaps go to the documents: of the keys that stay, and of those that go or are repeated. Rows that are in one of them
    alone need not be looked up, so hardly any texts are shuffled.
    """
    judged = near_duplicates(docs, key, text, words, percent).groupBy(F.col(key).alias("__key")).agg(F.bool_or("kept").alias("stays"), F.count("*").alias("rows"))
    judged = written(judged, "judged")
    stays = judged.where("stays").select("__key")
    look_up = key_bits(judged.where("NOT stays OR rows > 1"), "__key")
    named = among(docs.withColumn("__key", F.col(key).cast("long")), key_bits(stays, "__key"), "__key")
    plain = among(named, look_up, "__key", "left_anti").drop("__key")
    rest = among(named, look_up, "__key").withColumnRenamed("__key", "__own")
    rest = rest.join(stays, F.col("__own").eqNullSafe(F.col("__key")), "left_semi").drop("__own")
    return plain.unionByName(rest.dropDuplicates([key, text]))
