"""Fuzzy matching. ``levenshtein``, ``hamming`` and ``soundex`` run in the JVM; the others are Arrow-batched."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fuzzy_leven(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def fuzzy_hamming(a: Column, b: Column) -> Column:
    """Places that differ; -1 if the lengths differ."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(a.isNull() | b.isNull(), None).when(F.length(a) != F.length(b), -1).when(F.length(a) == 0, 0).otherwise(F.aggregate(pairs, F.lit(0), lambda n, x: n + x))


def osa_distance(a: str, b: str) -> int:
    """Edits with swaps of neighbours, no substring edited twice."""
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(old[j] + 1, new[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, older[j - 2] + 1)
            new.append(d)
        older, old = old, new
    return old[-1]


def damerau_distance(a: str, b: str) -> int:
    """Edits with swaps of neighbours, without restriction."""
    last: dict[str, int] = {}
    limit = len(a) + len(b)
    table = {(-1, j): limit for j in range(-1, len(b) + 1)} | {(i, -1): limit for i in range(-1, len(a) + 1)}
    table |= {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        match = 0
        for j, y in enumerate(b, 1):
            p, q = last.get(y, 0), match
            if x == y:
                match = j
            swap = table[p - 1, q - 1] + (i - p - 1) + 1 + (j - q - 1)
            table[i, j] = min(table[i - 1, j - 1] + (x != y), table[i, j - 1] + 1, table[i - 1, j] + 1, swap)
        last[x] = i
    return table[len(a), len(b)]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, hits = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                hits.append(x)
                break
    m = len(hits)
    if not m:
        return 0.0
    swaps = sum(x != y for x, y in zip(hits, (y for y, u in zip(b, used, strict=True) if u), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def refined_soundex(s: str) -> str:
    """The first letter, then the code of every letter, neighbours of one code once."""
    # The refined code of each letter from A to Z.
    codes = "01360240043788015936020505"
    s = re.sub("[^A-Z]", "", s.upper())
    if not s:
        return ""
    out, last = s[0], ""
    for x in s:
        code = codes[ord(x) - 65]
        if code != last:
            out += code
        last = code
    return out


def caverphone(s: str) -> str:
    """Caverphone 2.0: a key of ten characters."""
    # The rules of Caverphone 2.0, in order.
    rules = (
        ("[^a-z]", ""), ("e$", ""), ("^cough", "cou2f"), ("^rough", "rou2f"), ("^tough", "tou2f"), ("^enough", "enou2f"), ("^trough", "trou2f"), ("^gn", "2n"), ("mb$", "m2"),
        ("cq", "2q"), ("ci", "si"), ("ce", "se"), ("cy", "sy"), ("tch", "2ch"), ("c", "k"), ("q", "k"), ("x", "k"), ("v", "f"), ("dg", "2g"), ("tio", "sio"), ("tia", "sia"), ("d", "t"),
        ("ph", "fh"), ("b", "p"), ("sh", "s2"), ("z", "s"), ("^[aeiou]", "A"), ("[aeiou]", "3"), ("j", "y"), ("^y3", "Y3"), ("^y", "A"), ("y", "3"), ("3gh3", "3kh3"), ("gh", "22"), ("g", "k"),
        ("s+", "S"), ("t+", "T"), ("p+", "P"), ("k+", "K"), ("f+", "F"), ("m+", "M"), ("n+", "N"), ("w3", "W3"), ("wh3", "Wh3"), ("w$", "3"), ("w", "2"), ("^h", "A"), ("h", "2"),
        ("r3", "R3"), ("r$", "3"), ("r", "2"), ("l3", "L3"), ("l$", "3"), ("l", "2"), ("2", ""), ("3$", "A"), ("3", ""),
    )
    s = s.lower()
    for pattern, to in rules:
        s = re.sub(pattern, to, s)
    return (s + "1" * 10)[:10] if s else ""


def transliterate(s: str) -> str:
    """ASCII letters for accented ones; other characters beyond ASCII become ``?``."""
    special = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "Œ": "OE", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "TH", "ð": "d", "Ð": "D"}
    flat = unicodedata.normalize("NFKD", "".join(special.get(c, c) for c in s))
    return "".join(c if ord(c) < 128 else "?" for c in flat if not unicodedata.combining(c))


def _two(f: Callable, kind: str) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)])

    return lambda a, b: run(a.cast("string"), b.cast("string"))


def _one(f: Callable) -> Callable[[Column], Column]:
    @F.pandas_udf("string")
    def run(a: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in a])

    return lambda a: run(a.cast("string"))


def _phonetic(s: str) -> str:
    """Consonant classes, vowels as ``a``: like-sounding words get like keys."""
    out = ""
    groups = {"b": "bp", "c": "cgjkqsxz", "d": "dt", "f": "fv", "l": "l", "m": "mn", "r": "r"}
    table = {x: k for k, v in groups.items() for x in v}
    for x in re.sub("[^a-z]", "", transliterate(s).lower()):
        k = table.get(x, "" if x in "hw" else "a")
        if k and not out.endswith(k):
            out += k
    return out.upper()


#: Name to a function of columns.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "fuzzy_leven": fuzzy_leven,
    "fuzzy_hamming": fuzzy_hamming,
    "fuzzy_soundex": lambda a: F.soundex(a),
}


def functions() -> dict[str, Callable[..., Column]]:
    """All fuzzy functions by name (needs a running session)."""
    return FUNCTIONS | {
        "fuzzy_damlev": _two(damerau_distance, "int"),
        "fuzzy_osadist": _two(osa_distance, "int"),
        "fuzzy_jarowin": _two(jaro_winkler, "double"),
        "fuzzy_editdist": _two(osa_distance, "int"),
        "fuzzy_rsoundex": _one(refined_soundex),
        "fuzzy_caver": _one(caverphone),
        "fuzzy_phonetic": _one(_phonetic),
        "fuzzy_translit": _one(transliterate),
    }


def register(spark) -> None:
    """SQL names for those that no SQL expression covers."""
    def two(f, kind):
        @F.pandas_udf(kind)
        def run(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)])

        return run

    def one(f):
        @F.pandas_udf("string")
        def run(a: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else f(x) for x in a])

        return run

    for name, f, kind in (("fuzzy_damlev", damerau_distance, "int"), ("fuzzy_osadist", osa_distance, "int"), ("fuzzy_editdist", osa_distance, "int"), ("fuzzy_jarowin", jaro_winkler, "double")):
        spark.udf.register(name, two(f, kind))
    for name, f in (("fuzzy_rsoundex", refined_soundex), ("fuzzy_caver", caverphone), ("fuzzy_phonetic", _phonetic), ("fuzzy_translit", transliterate)):
        spark.udf.register(name, one(f))


#: Rows of one string that a task of :func:`fuzzy_join` holds at once, about.
GROUP = 100_000


def fuzzy_join(left: DataFrame, right: DataFrame, on: tuple[str, str], most: int, block: Callable[[Column], Column] | None = None) -> DataFrame:
    """Pairs at most ``most`` edits apart, with ``distance``.

    Exact blocking: two strings at most k edits apart have one of k + 1 equal pieces of the shorter in
    common, at a place shifted by at most k. The left string's pieces meet the right string's substrings;
    strings too short for k + 1 pieces meet by length. ``block`` replaces this by one key (not exact).

    Pieces are made of distinct strings only, and the pairs of strings are joined back to the rows. No side is
    broadcast: the optimiser's estimate does not know how many pieces a string has. The rows of a string
    on the right are dealt to groups of about ``GROUP``, so that a common string is no task of its own.
    """
    a, b = F.col(on[0]), F.col(on[1])
    if block is not None:
        pairs = left.withColumn("_k", block(a)).join(right.withColumn("_k", block(b)), "_k").drop("_k")
        return pairs.withColumn("distance", F.levenshtein(a, b, most)).filter("distance >= 0")
    k = most
    piece = lambda s, i, n: F.substring(s, (F.floor(n * i / (k + 1)) + 1).cast("int"), (F.floor(n * (i + 1) / (k + 1)) - F.floor(n * i / (k + 1))).cast("int"))
    n = F.length("_a")
    keys = F.array(*[F.struct(F.lit(i).alias("i"), n.alias("n"), piece(F.col("_a"), i, n).alias("p")) for i in range(k + 1)])
    ours = left.select(a.alias("_a")).filter("_a is not null").distinct().withColumn("_k", F.explode(keys))
    own = F.length("_b")
    lengths = F.sequence(F.greatest(F.lit(0), own - k), own + k)

    def shifted(m: Column, i: int) -> Column:
        start = F.floor(m * i / (k + 1)).cast("int")
        size = F.floor(m * (i + 1) / (k + 1)).cast("int") - start
        return F.transform(F.sequence(F.greatest(F.lit(0), start - k), start + k), lambda at: F.struct(F.lit(i).alias("i"), m.alias("n"), F.substring("_b", at + 1, size).alias("p")))

    def places(m: Column) -> Column:
        return F.flatten(F.array(*[shifted(m, i) for i in range(k + 1)]))

    texts = right.select(b.alias("_b")).filter("_b is not null").groupBy("_b").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("_n"))
    theirs = texts.withColumn("_k", F.explode(F.array_distinct(F.flatten(F.transform(lengths, places)))))
    pairs = ours.join(theirs.hint("merge"), "_k").withColumn("_d", F.levenshtein("_a", "_b", most)).filter("_d >= 0").select("_a", "_b", "_n", "_d").distinct()
    found = left.join(pairs.hint("merge"), a == F.col("_a")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    # At most one string for every GROUP rows of the right side is broadcast.
    common = texts.filter("_n > 1").select(F.col("_b").alias("_t"), F.col("_n").alias("_m"))
    plain = [c for c, t in right.dtypes if "map<" not in t and "variant" not in t]
    rows = right.join(F.broadcast(common), b == F.col("_t"), "left").withColumn("_g", F.coalesce(F.pmod(F.xxhash64(*plain), F.col("_m")).cast("int"), F.lit(0)))
    out = found.join(rows.hint("merge"), (F.col("_b") == b) & (F.col("_s") == F.col("_g")))
    return out.withColumn("distance", F.col("_d")).drop("_a", "_b", "_n", "_d", "_s", "_t", "_m", "_g")
