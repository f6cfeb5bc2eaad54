"""Benchmark decontamination by spaced seeds that no accepted passage can avoid.

Tokens are lower-cased runs of letters and digits, hashed to 64 bits. A passage of ``w`` aligned tokens
(``overlap``, or the whole item, if shorter) is accepted if at least ``percent`` of them are equal. Fixed masks
say which tokens of a stretch are hashed and which are ignored; for every length of ``w`` there is a family
of masks such that, however the allowed substitutions lie, some mask fits somewhere with all its hashed
tokens equal (``covers`` enumerates all cases). The hashes of all documents and items are joined; every hit
names a document, an item and an alignment, which is then verified token by token.

Only DataFrame functions are used. The benchmark's hashes are broadcast when counted and found to be
few (``broadcast_rows``); beyond, the same join shuffles. Documents are never grouped but by their own
id, on their hits.

Defined results: a null or empty text has no tokens and is never contaminated, and an empty item
contaminates nothing; items of equal text are all named; rows of the same ``doc_id`` are one document,
contaminated if any of its texts is; rows without a ``doc_id`` are returned unjudged (kept); with an empty
benchmark nothing is contaminated, and an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Masks by the least length of a passage they serve; 1 marks a token that is hashed. Each family
# meets every passage of its lengths at 80 per cent.
MASKS = {
    16: ("1111011", "1110100011", "10101111"),
    12: ("111011", "11111"),
    5: ("1111", "11011", "11101", "10111"),
    4: ("1111",),
    3: ("111",),
    2: ("11",),
    1: ("1",),
}


def covers(masks: tuple[str, ...], w: int, substituted: int) -> bool:
    """Whether some mask fits every pattern of so many substitutions in ``w`` tokens."""
    fits = [sum(1 << (at + i) for i, x in enumerate(m) if x == "1") for m in masks for at in range(w - len(m) + 1)]
    return all(any(not f & sum(1 << c for c in gone) for f in fits) for gone in combinations(range(w), substituted))


@dataclass(frozen=True)
class Overlap:
    overlap: int = 20
    percent: int = 80
    broadcast_rows: int = 500_000

    def masks(self, n: int) -> tuple[str, ...]:
        """The masks for items of ``n`` tokens; where the fixed ones do not meet every accepted passage, one run that does."""
        w = min(self.overlap, n)
        equal = -(-w * self.percent // 100)
        family = MASKS[max(k for k in MASKS if k <= w)]
        if w <= 20 and w - equal <= w // 5 or covers(family, w, w - equal):
            return family
        return ("1" * max(1, -(-equal // (w - equal + 1))),)


def token_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _key(mask: str) -> Column:
    """The hash of the tokens that the mask marks, from the place ``at`` on; null where it leaves the text."""
    own = [F.get("tokens", F.col("at") + i) for i, x in enumerate(mask) if x == "1"]
    return F.when(F.col("at") + len(mask) <= F.size("tokens"), F.xxhash64(F.lit(mask), *own))


def _hashed(d: DataFrame, ids: list[str], masks: list[str]) -> DataFrame:
    """``ids, at, key`` of all masks at all places, from one pass over the tokens."""
    d = d.select(*ids, "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - 1)).alias("at"))
    d = d.select(*ids, "at", F.explode(F.array(*[_key(m) for m in masks])).alias("key"))
    return d.filter("key is not null")


def find(docs: DataFrame, benchmark: DataFrame, p: Overlap = Overlap()) -> DataFrame:
    """``doc_id, item_id, shift, n_aligned, n_equal``: the verified alignments.

    ``shift`` is the place in the document of the item's first token (negative if it begins before).
    """
    d = docs.select(F.col("doc_id").cast("long"), token_hashes(F.col("text")).alias("tokens")).filter("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long"), token_hashes(F.col("text")).alias("tokens")).filter("item_id is not null and size(tokens) > 0")
    items = items.withColumn("n", F.size("tokens"))
    sizes = sorted(r[0] for r in items.select(F.least("n", F.lit(p.overlap))).distinct().collect())  # at most ``overlap`` numbers
    families: dict[tuple[str, ...], list[int]] = {}
    for n in sizes:
        families.setdefault(p.masks(n), []).append(n)
    masks = sorted({m for f in families for m in f})
    few = items.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= p.broadcast_rows
    sized = F.broadcast if few else (lambda x: x)
    nothing = F.lit(0).cast("long").alias("key")
    seeds, sought = items.limit(0).select("item_id", "n", F.lit(0).alias("at"), nothing), d.limit(0).select("doc_id", F.lit(0).alias("at"), nothing)
    for family, ns in families.items():
        seeds = seeds.unionByName(_hashed(items.filter(F.least("n", F.lit(p.overlap)).isin(ns)), ["item_id", "n"], list(family)))
    if masks:
        sought = _hashed(d.filter("size(tokens) > 0"), ["doc_id"], masks)
    seeds = seeds.withColumnRenamed("at", "item_at").distinct()

    hits = sought.join(sized(seeds), "key").select("doc_id", F.struct("item_id", "n", (F.col("at") - F.col("item_at")).alias("shift")).alias("hit"))
    hits = hits.distinct().groupBy("doc_id").agg(F.collect_list("hit").alias("hits"))
    # The aligned tokens are cut out before the hits are laid out in rows.
    start = lambda h: F.greatest(F.lit(0), h["shift"])
    own = lambda h: F.slice("tokens", start(h) + 1, F.least(F.size("tokens"), h["shift"] + h["n"]) - start(h))
    rows = d.join(hits, "doc_id").select("doc_id", F.explode(F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), h["n"].alias("n"), h["shift"].alias("shift"), start(h).alias("start"), own(h).alias("own")))).alias("hit"))
    rows = rows.select("doc_id", "hit.*")
    rows = rows.join(sized(items.withColumnRenamed("tokens", "item_tokens")), ["item_id", "n"])
    rows = rows.withColumn("theirs", F.slice("item_tokens", F.col("start") - F.col("shift") + 1, F.size("own")))
    rows = rows.withColumn("same", F.zip_with("own", "theirs", lambda x, y: (x == y).cast("int")))
    w = F.least(F.lit(p.overlap), F.col("n"))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    verified = F.when(F.size("same") < w, F.lit(False)).otherwise(
        F.exists(F.sequence(F.lit(0), F.size("same") - w), lambda i: total(F.slice("same", i + 1, w)) * 100 >= w * p.percent)
    )
    return rows.filter(verified).select("doc_id", "item_id", "shift", F.size("same").alias("n_aligned"), total(F.col("same")).alias("n_equal"))


def judge(docs: DataFrame, benchmark: DataFrame, p: Overlap = Overlap()) -> DataFrame:
    """``doc_id, contaminated, n_items, item_ids, kept`` for every row of ``docs``."""
    found = find(docs, benchmark, p).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    out = docs.select(F.col("doc_id").cast("long")).join(found, "doc_id", "left")
    hit = F.col("item_ids").isNotNull()
    return out.select("doc_id", hit.alias("contaminated"), F.when(hit, F.size("item_ids")).otherwise(0).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), (~hit).alias("kept"))
