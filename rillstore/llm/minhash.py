"""Near-duplicate groups by MinHash.

Sketches follow fast similarity sketching: in round i every element of a set is hashed to one of
``t`` bins with a value that grows with the round, and a bin keeps its least value; after ``t``
rounds, round ``t + b`` sends every element to bin b, so every coordinate is filled. Two sketches
agree in a coordinate with the probability of their Jaccard similarity, with concentration bounds
like those of ``t`` independent hash functions, in O(n + t log t) expected time.

``rows`` coordinates make a band. Texts with equal sets form a class, and only one text of each
class goes on. Texts with an equal band are candidates. First each bucket is compared with one member
only, that with the fewest shingles of its own; then, where a bucket still spans several components,
with other members, and last every remaining pair of different components that shares a bucket is
compared. Pairs are passed over only where they are proved to be too different: by the shingles that a
text shares with nobody, or by the parities of its shingles in hash slots.
Each comparison is exact, on the full sets. No bucket is gathered in one place, and no pair that could
still join two components is left out.

Defined results: a null or empty text, or one without words, has the empty set and is linked with
nothing; fewer than ``k`` words make one shingle; of rows with the same ``doc_id`` the smallest text
stands for all; rows without a ``doc_id`` are not grouped (component null, kept true); extra columns are ignored by :func:`components`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstore.cluster import cut, ship_package
from rillstore.llm import words as W


@dataclass(frozen=True)
class Near:
    """Words of a shingle, per cent of similarity, and the banding: 40 bands of 5 find a pair at a
    similarity of 0.8 but for one in 8 million."""

    k: int = 5
    percent: int = 80
    bands: int = 40
    rows: int = 5
    star_rounds: int = 3  # rounds of one member against its bucket, before all that is left
    few: int = 1000  # pairs left for each row of a bucket that are looked at at once


_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
_LOW = np.uint64(0xFFFFFFFF)
_32 = np.uint64(32)


def shingles(data: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, end to end, and how many each text has."""
    s, e, first = W.find(data, at)
    word = W.hashes(data, s, e, lower=True)
    gram = W.grams(word, k)
    out, sizes = [], np.zeros(len(at) - 1, np.int64)
    for i in range(len(at) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= k:
            own = np.unique(gram[a : b - k + 1])
        elif b > a:
            own = W.grams(word[a:b], b - a)
        else:
            continue
        sizes[i] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def sketch(items: np.ndarray, sizes: np.ndarray, t: int) -> np.ndarray:
    """A row of ``t`` coordinates for each set; rows of empty sets stay at the largest value."""
    out = np.full((len(sizes), t), _FULL, np.uint64)
    flat = out.ravel()
    run = np.repeat(np.arange(len(sizes)), sizes)
    live = np.flatnonzero(sizes)
    for i in range(2 * t):
        seed = W.mix(np.array([(i + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF], np.uint64))
        h = W.mix(items ^ seed)
        if i < t:
            place = run * t + (((h >> _32) * np.uint64(t)) >> _32).astype(np.int64)
        else:
            place = run * t + (i - t)
        np.minimum.at(flat, place, (np.uint64(i) << _32) | (h & _LOW))
        if i and i % 8 and i > 8:
            continue  # look for filled sketches now and then only
        live = live[(out[live] == _FULL).any(axis=1)]
        if not len(live):
            break
        going = np.zeros(len(sizes), bool)
        going[live] = True
        own = going[run]
        if not own.all():
            items, run = items[own], run[own]
    return out


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each sketch."""
    acc = np.broadcast_to(W.mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(sketches), bands)).copy()
    for r in range(rows):
        acc = W.mix(acc ^ sketches[:, r::rows][:, :bands]) + np.uint64(r)
    return acc.view(np.int64)


def _sketcher(p: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            items, sizes = shingles(*W.flat(b.column("text")), p.k)
            keys = band_keys(sketch(items, sizes, p.bands * p.rows), p.bands, p.rows)
            edge = np.concatenate([[0], np.cumsum(sizes)])
            same = []
            for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(W.mix(items ^ np.uint64(seed)))])
                same.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, p.bands, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), pa.array(same[0]), pa.array(same[1]), lists], ["doc_id", "n_shingles", "same_a", "same_b", "bands"])

    return run


def _shingler(p: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            items, sizes = shingles(*W.flat(b.column("text")), p.k)
            rep = np.repeat(np.asarray(b.column("doc_id")), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(items.view(np.int64))], ["rep", "shingle"])

    return run


#: Bits of a set's parities, as 64-bit numbers.
PARITIES = 16


def parities(items: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each set, whether each of ``64 * PARITIES`` hash slots holds an odd number of its items.

    Slots in which two sets differ hold at least one item of only one of them, so their number is at
    most the size of the sets' symmetric difference.
    """
    m = 64 * PARITIES
    slot = (W.mix(items ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(m)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * m + slot, minlength=len(sizes) * m).reshape(-1, m) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view("<i8")


def _parities(p: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            bits = parities(*shingles(*W.flat(b.column("text")), p.k))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(bits[:, i]) for i in range(PARITIES)]], ["rep", *[f"p{i}" for i in range(PARITIES)]])

    return run


def _verifier(p: Near):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            a_id, b_id = b.column("a").to_pylist(), b.column("b").to_pylist()
            ok = np.zeros(len(a_id), bool)
            for i, a in enumerate(a_id):
                if last[0] != a:
                    last = (a, shingles(*W.flat(b.column("text_a").slice(i, 1)), p.k)[0])
                x, y = last[1], shingles(*W.flat(b.column("text_b").slice(i, 1)), p.k)[0]
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok[i] = 100 * both >= p.percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a_id, pa.int64()), pa.array(b_id, pa.int64()), pa.array(ok)], ["a", "b", "ok"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, p: Near) -> DataFrame:
    """``(a, b, ok)`` for every pair, from the full sets. Hot members are split by the joins."""
    t_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    t_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    d = pairs.select("a", "b").join(t_b, "b").join(t_a, "a")
    return d.select("a", "b", "text_a", "text_b").mapInArrow(W.tidy(_verifier(p)), "a long, b long, ok boolean")


def connected(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of the nodes of ``edges(a, b)`` but the components' smallest: the smallest reachable.

    Alternates large-star and small-star steps until every node points to its component's smallest;
    their number grows with the logarithm of the graph. Every step is aggregates and joins on the
    edges, written to the shared folder.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while True:
        least = e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        chained = e.select(F.col("v").alias("u")).distinct().join(e, "u", "left_semi")
        if least.filter("n > 1").select("u").unionByName(chained).isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct())


def _labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    return rows.join(connected(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))


def components(docs: DataFrame, p: Near = Near()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``."""
    ship_package(docs.sparkSession)
    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    d = whole.filter("doc_id is not null")
    repeated = bool(d.groupBy("doc_id").count().filter("count > 1").limit(1).count())
    if repeated:
        d = cut(d.groupBy("doc_id").agg(F.min("text").alias("text")))
    kind = "doc_id long, n_shingles long, same_a long, same_b long, bands array<long>"
    known = cut(d.mapInArrow(W.tidy(_sketcher(p)), kind))

    # Classes of equal sets: only the smallest member goes on.
    own = ["n_shingles", "same_a", "same_b"]
    classes = cut(known.filter("n_shingles > 0").groupBy(*own).agg(F.min("doc_id").alias("rep")))
    reps = known.join(classes.select(F.col("rep").alias("doc_id"), *own), ["doc_id", *own]).select(F.col("doc_id").alias("rep"), "n_shingles", "bands")
    rows = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))

    # Buckets of two or more, and the texts they hold.
    many = rows.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    buckets = cut(rows.join(cut(many), "key"))
    texts = cut(d.join(buckets.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi"))

    # Shingles that no other such text has bound every similarity of a text: what two texts share is
    # at most the smaller number of other shingles. Texts that can reach nobody leave.
    lone = texts.mapInArrow(W.tidy(_shingler(p)), "rep long, shingle long").groupBy("shingle").agg(F.count("*").alias("c"), F.min("rep").alias("rep"))
    lone = lone.filter("c = 1").groupBy("rep").agg(F.count("*").alias("own"))
    facts = ["rep", "n", "own", "component", *[f"p{i}" for i in range(PARITIES)]]
    odd = texts.mapInArrow(W.tidy(_parities(p)), "rep long, " + ", ".join(f"p{i} long" for i in range(PARITIES)))
    members = buckets.join(odd.join(lone, "rep", "left").withColumn("own", F.coalesce("own", F.lit(0))), "rep")
    members = cut(members.filter(f"100 * (n - own) >= {p.percent} * n"))
    fits = f"100 * least(n_a - own_a, n_b - own_b) >= {p.percent} * (n_a + n_b - least(n_a - own_a, n_b - own_b))"
    differ = " + ".join(f"bit_count(p{i}_a ^ p{i}_b)" for i in range(PARITIES))
    fits += f" AND {100 + p.percent} * ({differ}) <= {100 - p.percent} * (n_a + n_b)"

    def side(x: DataFrame, name: str) -> DataFrame:
        return x.select("key", *[F.col(c).alias(f"{c}_{name}") for c in facts])

    tested: list[DataFrame] = []  # (a, b, ok)
    open_ = members.withColumn("component", F.col("rep"))
    for r in range(p.star_rounds + 1):
        every = r == p.star_rounds
        if r:
            links = reduce(DataFrame.unionByName, tested).filter("ok").select("a", "b")
            open_ = _labelled(members, links).select("key", *facts)
            spans = open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
            open_ = cut(open_.join(spans, "key", "left_semi"))
            sizes = open_.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("within"))
            n, crossing = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("within")) / 2), F.lit(0))).first()
            if not n:
                break
            every = every or crossing <= p.few * n
        left = side(open_, "a")
        if not every:  # one member of each bucket, of those with the fewest own shingles, for all the others
            lead = F.struct(F.floor(F.col("own_a") / (4 if r else 1)), F.xxhash64("rep_a", F.lit(r)))
            left = left.groupBy("key").agg(F.min_by(F.struct(*[f"{c}_a" for c in facts]), lead).alias("x")).select("key", "x.*")
        pairs = left.join(side(open_, "b"), "key").filter("component_a < component_b" if every else "component_a <> component_b").filter(fits)
        pairs = pairs.select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()
        if tested:
            pairs = pairs.join(reduce(DataFrame.unionByName, tested).select("a", "b"), ["a", "b"], "left_anti")
        tested.append(cut(verify(cut(pairs), texts, p)))
        if every:
            break

    found = connected(reduce(DataFrame.unionByName, tested).filter("ok").select("a", "b")).withColumnRenamed("node", "rep")
    to = cut(classes.join(found, "rep", "left").select(*own, F.coalesce("component", "rep").alias("_component")))
    out = known.select("doc_id", *own).join(to, own, "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("_component", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    if repeated:
        out = whole.select("doc_id").filter("doc_id is not null").join(cut(out), "doc_id")
    rest = whole.filter("doc_id is null").mapInArrow(W.tidy(_sketcher(p)), kind)
    return out.unionByName(rest.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))
