"""Near duplicates by n-gram Jaccard similarity: a parity-sketch join.

A text's set holds the hashes of its distinct shingles.  Two sets of a and b
elements with similarity of at least t differ in at most
``(1 - t) / (1 + t) * (a + b)`` elements.  Hash space is cut into more blocks
than that, and each block of a set is XORed to a parity word: by the pigeonhole
principle similar sets agree in some block.  Sizes are banded; in a band the
number of blocks follows its largest allowed difference, plus ``z`` blocks, so
that a set with at most ``z`` empty blocks agrees in one that is not empty.
Sets with more empty blocks meet again under further seeds, and at last by
single elements, so no link is lost.

Exact copies collapse into one class first (a set's fingerprint).  In each
group of classes that share a parity word the one with most company leads, and
every class is compared with the leader it shares most words with; so is it
once more with other leaders.  All pairs that still lie in different components
are then taken from all shared words.  Before sets are compared, a sketch of one parity bit per hash slot bounds their difference
from below by its Hamming distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_lookup
from ..session import materialize, tasks_for, temporary_tables
from .common import as_bytes, releasing, slices, space_words
from .exchange import pack, parts_for, runs, unpack

U = np.uint64
SHINGLE, NUM, DEN = 5, 80, 100          # words of a shingle; the similarity as a fraction
SEEDS = 4
FLUSH = 250_000                         # parity words that a map task holds before it routes them
_P = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * _P[3]
    x = (x ^ (x >> U(29))) * _P[4]
    return x ^ (x >> U(32))


class Words(dict):
    """Hashes of words, forgotten all at once when there are many."""

    def __missing__(self, word):
        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: bytes | None, words: Words) -> np.ndarray:
    """Sorted hashes of the distinct shingles; of fewer words, one of them all."""
    found = space_words(text.lower()) if text else []
    if not found:
        return np.zeros(0, U)
    if len(found) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), len(found))], U)
    w = np.fromiter(map(words.__getitem__, found), U, len(found))
    h = np.zeros(len(w) - SHINGLE + 1, U)
    for k in range(SHINGLE):
        h = (h ^ w[k:len(w) - SHINGLE + 1 + k]) * _P[k]
        h ^= h >> U(31)
    return np.unique(mix(h))


def fingerprint(h: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(h.tobytes(), 11), U).view(np.int64))


class Band:
    """Sizes of the smaller set from ``low`` to ``high``; parity words of any set that may be in such a pair."""

    def __init__(self, number: int, low: int, high: int):
        self.number, self.low, self.high = number, low, high
        self.most = high * DEN // NUM                       # the larger set
        k = (DEN - NUM) * (high + self.most) // (DEN + NUM)  # their difference
        z = 0
        while True:
            blocks = k + 1 + z
            empty = blocks * np.exp(-low / blocks)
            need = 0 if blocks == 1 else int(np.ceil(empty + 2 * np.sqrt(empty)))
            if z >= min(need, 3 * k + 3):
                break
            z += 1
        self.blocks, self.spare = blocks, z

    def keys(self, h: np.ndarray) -> np.ndarray:
        """Parity words of the sorted set ``h``, as keys that no other band, seed or block has."""
        out = []
        for seed in range(SEEDS):
            x = h if seed == 0 else np.sort(mix(h ^ (_P[0] * U(seed))))
            block = ((x >> U(32)) * U(self.blocks)) >> U(32)
            start = runs(block)
            word = np.bitwise_xor.reduceat(mix(x ^ _P[1]), start)
            out.append(mix(word ^ mix(block[start] + U((self.number * SEEDS + seed) << 32))))
            if self.blocks - len(start) <= self.spare:
                return np.concatenate(out)
        return np.concatenate([*out, mix(h ^ U(self.number * 2 + 1))])


class Bands:
    def __init__(self):
        self.bands, self.lows = [], []

    def of(self, n: int) -> list[Band]:
        """Bands in which a set of ``n`` elements is the smaller or the larger one of a similar pair."""
        while not self.bands or self.bands[-1].high < n:
            low = self.bands[-1].high + 1 if self.bands else 1
            self.bands.append(Band(len(self.bands), low, max(low, low * 3 // 2 - 1)))
        least = -(-n * NUM // DEN)
        return [b for b in self.bands if b.high >= least and b.low <= n]


_ROUTED = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])
_ROUTED_SQL = "part int, kind string, data binary"


def _set_map(parts: int):
    """Documents' fingerprints, and the parity words of every set that is new to the task."""
    def run(batches):
        words, bands, seen = Words(), Bands(), set()
        docs, keys, owner, classes, sizes, held = [], [], [], [], [], 0

        def flush():
            key, who = np.concatenate(keys), np.repeat(np.arange(len(owner)), owner)
            part = (key % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edge = np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p in range(parts):
                at = order[edge[p]:edge[p + 1]]
                if len(at):
                    used, index = np.unique(who[at], return_inverse=True)
                    head = pack([np.array(classes, np.int64)[used], np.array(sizes, np.int64)[used]])
                    rows.append((p, "keys", len(head).to_bytes(8, "little") + head + pack([key[at] >> U(16), index.astype(np.int64)])))
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ROUTED, strict=True)], schema=_ROUTED)

        for b in slices(batches, 512):
            b = b.filter(b.column(0).is_valid())
            for i, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                h = shingles(text, words)
                n = len(h)
                f = fingerprint(h) if n else 0
                docs.append((i, n, f))
                if not n or f in seen:
                    continue
                seen.add(f)
                mine = np.concatenate([band.keys(h) for band in bands.of(n)])
                keys.append(mine)
                owner.append(len(mine))
                classes.append(f)
                sizes.append(n)
                held += len(mine)
                if held > FLUSH:
                    yield flush()
                    keys, owner, classes, sizes, held = [], [], [], [], 0
        if keys:
            yield flush()
        if docs:
            cols = np.array(docs, np.int64).T
            data = [pack([c[a:a + 50_000] for c in cols]) for a in range(0, len(docs), 50_000)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(data), pa.int32()), pa.array(["docs"] * len(data)), pa.array(data, pa.binary())], schema=_ROUTED)
    return run


def _bucket_reduce(batches):
    """Buckets: keys that two classes or more share, as (bucket, class, size) records."""
    heads, bodies, base = [], [], 0
    for b in batches:
        for kind, raw in zip(b.column("kind").to_pylist(), b.column("data"), strict=True):
            data = raw.as_py()
            if kind == "docs":
                yield pa.RecordBatch.from_arrays([pa.array(["docs"]), pa.array([data], pa.binary())], ["kind", "data"])
                continue
            k = int.from_bytes(data[:8], "little")
            head, (key, index) = unpack(data[8:8 + k]), unpack(data[8 + k:])
            heads.append(head)
            bodies.append((key, index + U(base)))
            base += len(head[0])
    if not bodies:
        return
    cls, size = (np.concatenate(c) for c in zip(*heads, strict=True))
    key, index = (np.concatenate(c) for c in zip(*bodies, strict=True))
    del heads, bodies
    order = np.argsort(key, kind="stable")
    key, index = key[order], index[order]
    start = runs(key)
    n = np.diff(np.append(start, len(key)))
    many = np.repeat(n > 1, n)
    key, index = key[many], index[many].astype(np.int64)
    c = cls[index].view(np.int64)
    order = np.lexsort((c, key))
    key, c, index = key[order], c[order], index[order]
    new = runs(key, c)
    key, c, size = key[new], c[new], size[index[new]].astype(np.int64)
    start = runs(key)
    n = np.diff(np.append(start, len(key)))
    many = np.repeat(n > 1, n)
    key, c, size = key[many], c[many], size[many]
    if not len(key):
        return
    n = n[n > 1]
    mates = np.repeat(n, n)
    yield from _blobs("buckets", [key.view(np.int64), c, size, mates])
    # Votes: how many of these buckets a class shares with their leaders, the classes with most company here.
    who, at = np.unique(c, return_inverse=True)
    degree = np.bincount(at, mates - 1)[at]
    order = np.lexsort((c, -degree, key))
    lead = np.repeat(order[runs(key)], n)
    ok = (c[lead] != c) & _may_be_similar(size, size[lead])
    a, b = c[ok], c[lead][ok]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    start = runs(a, b)
    yield from _blobs("votes", [a[start], b[start], np.diff(np.append(start, len(a)))])


def _blobs(kind: str, columns: list[np.ndarray]):
    for a in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind]), pa.array([pack([c[a:a + 100_000] for c in columns])], pa.binary())], ["kind", "data"])


def _may_be_similar(a, b):
    return NUM * np.maximum(a, b) <= DEN * np.minimum(a, b)


def _unpacked(rows: DataFrame, kind: str, names: list[str]) -> DataFrame:
    """The records of one kind as rows of longs."""
    def run(batches):
        for b in slices(batches, 1):
            for raw in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in unpack(raw.as_py())], names)

    return rows.filter(F.col("kind") == kind).select("data").mapInArrow(releasing(run), ", ".join(f"{n} long" for n in names))


def sketch(h: np.ndarray) -> bytes:
    """Parity bits by hash slot; a power of two of them, at least four for each element."""
    bits = max(64, 1 << int(4 * len(h) - 1).bit_length())
    odd = np.bincount((h % U(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(words: np.ndarray, to: int) -> np.ndarray:
    """A sketch (64-bit words, last axis) folded to fewer slots: slots that fall together add up mod 2."""
    while words.shape[-1] > to:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def _limit(a, b):
    """The largest difference of similar sets of a and b elements."""
    return (DEN - NUM) * (a + b) // (DEN + NUM)


def _close(batches):
    """Pairs whose sketches don't rule them out."""
    for b in batches:
        na, nb = (b.column(c).to_numpy() for c in ("na", "nb"))
        keep = []
        for x, y, limit in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist(), _limit(na, nb).tolist(), strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            to = min(len(x), len(y))
            keep.append(int(np.bitwise_count(fold(x, to) ^ fold(y, to)).sum()) <= limit)
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _linked(batches):
    """Pairs whose sets are similar."""
    for b in slices(batches, 256):
        keep = []
        for x, y in zip(b.column("ha").to_pylist(), b.column("hb").to_pylist(), strict=True):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            both = len(x) + len(y) - len(np.union1d(x, y))
            keep.append(DEN * both >= NUM * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verify(pairs: DataFrame, sets: DataFrame, most: int | None = None) -> DataFrame:
    """The pairs (a, b) of classes (at most ``most``, if known) that are similar: first by sketches, then by whole sets."""
    close = _both(materialize(pairs, rows=most), sets, {"n": "n", "s": "sketch"}).mapInArrow(releasing(_close), "a long, b long")
    return _both(materialize(close), sets, {"h": "hashes"}).mapInArrow(releasing(_linked), "a long, b long")


def _both(pairs: DataFrame, sets: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Stored pairs with columns of both classes.

    Up to ``BROADCAST_CLASSES`` pairs go to the sets, so only the sets that
    occur in a pair are shuffled, to the pair's second class.
    """
    def side(x: str) -> DataFrame:
        return sets.select(F.col("cls").alias(x), *[F.col(v).alias(k + x) for k, v in columns.items()])

    n = pairs.count()
    sent = F.broadcast if n <= BROADCAST_CLASSES else (lambda df: df)
    second = side("b").join(sent(pairs.select("b").distinct()), "b", "left_semi")
    both = side("a").join(sent(pairs), "a").join(second, "b").select("a", "b", *[k + x for k in columns for x in "ab"])
    return both.coalesce(tasks_for(n, PAIRS_PER_TASK))


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Connected components of (a, b) edges: ``node, root``, the root being the smallest node.

    Large-star and small-star rounds, each a grouping with partial minima and
    a join; every round is written to the shared folder.  Nodes without an
    edge do not appear.  ``most``: a bound of the number of edges, if known.
    Partitions follow the number of edges, so that a small graph's rounds are
    few tasks.
    """
    def both_ways(e: DataFrame, second) -> DataFrame:
        ways = F.explode(F.array(F.struct("a", "b"), second))
        return e.select(ways.alias("e")).select("e.a", "e.b")

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = both_ways(e, F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
            least = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            moved = e.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            least = e.groupBy("a").agg(F.min("b").alias("m"))
            moved = (e.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .union(least.select("a", F.col("m").alias("b"))))
        return moved.filter(F.col("a") != F.col("b")).distinct()

    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), rows=most)
    before, n = None, most
    while True:
        few = edges if n is None else edges.coalesce(tasks_for(n))
        state = tuple(few.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        n = state[0]
        edges = edges.coalesce(tasks_for(n))
        if state == before or n == 0:
            return both_ways(edges, F.struct(F.col("b").alias("a"), "b")).distinct().toDF("node", "root")
        before = state
        edges = materialize(star(materialize(star(edges, True), rows=n).coalesce(tasks_for(n)), False), rows=2 * n)
        n *= 2


TILE = 4096
#: Classes that share a key, up to which their ids (16 bytes each) go to all tasks; beyond, texts are shuffled to them.
BROADCAST_CLASSES = 1_000_000
#: Pairs that a task compares at least.
PAIRS_PER_TASK = 4096


def _bucket_pairs(batches):
    """Pairs of different components and near sketches within tiles; rows come sorted by (lead, i, j, bucket).

    Buckets with the same lead mostly hold the same classes, so pairs met
    before in the task are not given out again.
    """
    met: set = set()

    def pairs(rows):
        i, j = rows[0][1], rows[0][2]
        words = min(len(r[8]) for r in rows) // 8
        bits = np.array([fold(np.frombuffer(r[8], "<u8"), words) for r in rows])
        cls, n, comp, salt = (np.array([r[k] for r in rows], np.int64) for k in (4, 5, 6, 7))
        for x in range(len(rows)):
            if salt[x] != i:
                continue
            others = cls != cls[x] if i != j else cls > cls[x]
            others &= (salt == j) & (comp != comp[x]) & _may_be_similar(n, n[x])
            at = np.flatnonzero(others)
            at = at[np.bitwise_count(bits[at] ^ bits[x]).sum(1) <= _limit(n[at], n[x])]
            me = int(cls[x])
            if len(met) > 1_000_000:
                met.clear()
            for other in cls[at].tolist():
                pair = (min(other, me), max(other, me))
                if pair not in met:
                    met.add(pair)
                    yield pair

    def out(found):
        a, b = zip(*found, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    held, found = [], []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:4] != held[0][:4]:
                found.extend(pairs(held))
                held = []
            held.append(row)
            if len(found) > 50_000:
                yield out(found)
                found = []
    if held:
        found.extend(pairs(held))
    if found:
        yield out(found)


def _small(table: DataFrame) -> DataFrame:
    """A stored table of one row per class: to all tasks up to the bound, else left to the shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_CLASSES else table


def open_buckets(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the buckets that hold several components, with the component, the bucket's smallest class and size."""
    rows = buckets.join(_small(comps), "cls")
    mixed = (rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("cls").alias("lead"))
                 .filter("lo != hi").select("bucket", "lead"))
    return rows.join(mixed, "bucket")


def star_pairs(rows: DataFrame, priority) -> DataFrame:
    """One pair per class: with the leader it shares most buckets with.

    A bucket's leader is its class of highest ``priority``; only leaders of
    another component and a similar size count.  ``rows``: bucket, cls, n, comp.
    """
    lead = rows.groupBy("bucket").agg(F.max(F.struct(priority.alias("p"), "cls", "n", "comp")).alias("l"))
    votes = (rows.join(lead, "bucket").filter((F.col("comp") != F.col("l.comp"))
                                              & (NUM * F.greatest("n", "l.n") <= DEN * F.least("n", "l.n")))
                 .groupBy(F.col("cls").alias("a"), F.col("l.cls").alias("b")).agg(F.count("*").alias("votes")))
    return elected(votes)


def elected(votes: DataFrame) -> DataFrame:
    """Each class with the leader that has most votes."""
    return votes.groupBy("a").agg(F.max(F.struct("votes", "b")).alias("x")).select("a", F.col("x.b").alias("b"))


def merge(comps: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """Components after links between classes: ``cls, comp``, of ``n`` rows as before."""
    def name(x: str) -> DataFrame:
        return comps.select(F.col("cls").alias(x), F.col("comp").alias(f"c{x}"))

    with temporary_tables(comps.sparkSession):
        links = materialize(links)
        many = links.count()
        if not many:
            return comps
        sent = F.broadcast if many <= BROADCAST_CLASSES else (lambda df: df)
        edges = name("b").join(sent(name("a").join(sent(links), "a")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = components(edges, many)
        return materialize(comps.join(sent(joined.withColumnRenamed("node", "comp")), "comp", "left")
                                .select("cls", F.coalesce("root", "comp").alias("comp")), rows=n, keep=True)


def cross_pairs(buckets: DataFrame, comps: DataFrame, sets: DataFrame, small: int = 8, most: int | None = None) -> DataFrame:
    """Pairs of classes that share a bucket but no component, without those that sizes or sketches rule out.

    Buckets of up to ``small`` classes give their pairs by a self-join; larger
    ones are cut into tiles of at most about ``TILE`` classes a side, in which
    sketches are compared before a pair is given out.  ``most``: a bound of the
    buckets' rows, if known.
    """
    rows = materialize(open_buckets(buckets, comps), rows=most)
    few = rows.filter(F.col("g") <= small)

    def side(x: str) -> DataFrame:
        return few.select("bucket", F.col("cls").alias(x), F.col("n").alias(f"n{x}"), F.col("comp").alias(f"c{x}"))

    some = (side("a").join(side("b"), "bucket")
            .filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
                    & (NUM * F.greatest("na", "nb") <= DEN * F.least("na", "nb"))).select("a", "b"))
    tiles = (rows.filter(F.col("g") > small)
                 .withColumn("t", F.ceil(F.col("g") / TILE).cast("long"))
                 .withColumn("salt", F.pmod(F.xxhash64("cls"), F.col("t")))
                 .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("t") - 1)))
                 .select("lead", F.least("salt", "other").alias("i"), F.greatest("salt", "other").alias("j"),
                         "bucket", "cls", "n", "comp", "salt")
                 .join(sets.select("cls", "sketch"), "cls")
                 .select("lead", "i", "j", "bucket", "cls", "n", "comp", "salt", "sketch")
                 .repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j", "bucket")
                 .mapInArrow(releasing(_bucket_pairs), "a long, b long"))
    return some.union(tiles).distinct()


def _class_sets(batches):
    words = Words()
    for b in slices(batches, 256):
        rows = []
        for cls, text in zip(b.column("cls").to_pylist(), as_bytes(b.column("text")), strict=True):
            h = shingles(text, words)
            if len(h) and fingerprint(h) == cls:
                rows.append((cls, len(h), sketch(h), h.tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)],
                ["cls", "n", "sketch", "hashes"])


def _class_components(base: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """``cls, component_id, copies``: each class of equal sets with the smallest id of its component."""
    classes = materialize(rows.filter("n > 0").groupBy("cls").agg(F.min("doc").alias("rep"), F.count("*").alias("copies")))
    most = classes.count()
    buckets = _unpacked(found, "buckets", ["bucket", "cls", "n", "g"])
    own = materialize(buckets.select("cls").distinct().select("cls", F.col("cls").alias("comp")), rows=most)
    n = own.count()
    needed = classes.join(own, "cls").select("cls", F.col("rep").alias("doc"))
    texts = base.filter(F.col("doc").isNotNull())
    texts = texts.join(F.broadcast(needed) if n <= BROADCAST_CLASSES else needed, "doc")
    sets = materialize(texts.select("cls", "text")
                            .mapInArrow(releasing(_class_sets), "cls long, n long, sketch binary, hashes binary"))
    votes = _unpacked(found, "votes", ["a", "b", "votes"]).groupBy("a", "b").agg(F.sum("votes").alias("votes"))
    comps = merge(own, verify(elected(votes), sets, n), n)
    left = materialize(open_buckets(buckets, comps))
    many = left.count()
    company = materialize(left.groupBy("cls").agg(F.sum("g").alias("company")), rows=n)
    comps = merge(comps, verify(star_pairs(left.join(_small(company), "cls"), F.col("company")), sets, n), n)
    left = materialize(open_buckets(left.drop("comp", "lead"), comps), rows=many)
    comps = merge(comps, verify(star_pairs(left, F.xxhash64("cls")), sets, n), n)
    comps = merge(comps, verify(cross_pairs(left.drop("comp", "lead"), comps, sets, most=many), sets), n)
    named = classes.join(comps, "cls", "left").select("cls", "rep", "copies", F.coalesce("comp", "cls").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    return materialize(named.join(least, "comp").select("cls", "component_id", "copies"), rows=most, keep=True)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` per row: the smallest id reachable by links, itself included.

    Null and empty texts have no shingles and are linked with nothing.  Rows
    with a null id are left out.  Rows that share an id are separate nodes with
    that id.  Sets are compared by 64-bit hashes of their shingles.
    """
    parts = parts_for(docs)
    base = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    found = materialize(base.mapInArrow(releasing(_set_map(parts)), _ROUTED_SQL)
                            .repartition(parts, F.coalesce("part", F.pmod(F.xxhash64("data"), F.lit(parts)).cast("int")))
                            .mapInArrow(releasing(_bucket_reduce), "kind string, data binary"))
    rows = _unpacked(found, "docs", ["doc", "n", "cls"])
    with temporary_tables(docs.sparkSession):
        dim = _class_components(base, found, rows)
    linked = salted_lookup(rows, dim, "cls", weight_col="copies", how="left", salt_cols=["doc"])
    return linked.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"),
                         F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))


def representatives(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the documents that have a smaller id in their component.

    Rows with a null id stay, and so do rows that share their component's
    smallest id.  The ids to drop go to all tasks up to ``BROADCAST_CLASSES``;
    beyond, rows are shuffled to them.
    """
    with temporary_tables(docs.sparkSession):
        near = near_duplicates(docs, id_col=id_col, text_col=text_col)
        drop = near.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__drop")).distinct()
        drop = materialize(drop, keep=True)
    side = F.broadcast(drop) if drop.count() <= BROADCAST_CLASSES else drop
    return docs.join(side, F.col(id_col).cast("long") == F.col("__drop"), "left_anti")
