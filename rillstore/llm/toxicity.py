"""Toxicity by nearest labelled examples.

Examples are a bounded sample of labelled documents (``per_label`` of each label, those of least hash).
Every lower-cased word of theirs is a term; none is left out. A term's weight in a text is its TF-IDF (frequency
in the text by 1 + log, rarity among all documents) times its association with the labels in the
sample (phi squared: chi-square, corrected for continuity, over the number of examples, in which near copies
count once), so that what the labels do not depend on weighs little however rare it is. Every document is compared with the examples by
the cosine of these weights in an inverted index: postings of rare terms are read whole; examples lie in
blocks, and a block's largest weight of each frequent term bounds what those add to the cosine of its
examples. Blocks are read in order of that bound, and reading stops when the bound falls to the k-th best
cosine, so the k nearest are exact. Their votes, weighted by cosine, are mapped to chances by a logistic curve
fitted to the sample's own leave-one-out votes, weighted to the labels' true shares.

Defined results: a null or empty text, or one without a known term, gets the labels' base rate; equal
cosines (to 6 decimals) go to the earlier example; repeated rows are scored each on their own; a document
labelled more than once counts as toxic if any label says so; without examples of both labels every
score is the base rate (0 without labels); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstore.cluster import cut, ship_package
from rillstore.llm import words as W

RESULT = "doc_id long, held_out boolean, score double, predicted int, evidence array<long>"


@dataclass(frozen=True)
class Toxic:
    per_label: int = 1000  # labelled documents of each label that are fitted
    k: int = 15
    block: int = 64
    frequent: float = 0.06  # share of the examples from which on a term's postings are kept by block


#: Documents compared at once.
ROWS = 512


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and the text it is in."""
    data, at = W.flat(col)
    s, e, first = W.find(data, at, W.LETTERS)
    return W.hashes(data, s, e, lower=True), np.repeat(np.arange(len(at) - 1), np.diff(first))


def counts(col: pa.Array, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, term (its place in the sorted vocabulary) and how often the text has it."""
    word, text = words(col)
    v = len(vocabulary)
    if not v:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.minimum(np.searchsorted(vocabulary, word), v - 1)
    own = vocabulary[place] == word
    key, n = np.unique(text[own] * v + place[own], return_counts=True)
    return key // v, key % v, n


def weigh(text: np.ndarray, term: np.ndarray, n: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Weights of each text's terms, their squares summing to 1 (or 0)."""
    x = (1 + np.log(n)) * weight[term]
    return x / np.maximum(np.sqrt(np.bincount(text, x * x, minlength=rows)), 1e-12)[text]


@dataclass
class Index:
    """Examples in blocks. Rare terms: ``at[t]`` to ``at[t + 1]`` are the places of term t in ``example`` and
    ``value``. Frequent ones: ``column[t]`` (else -1) is the term's row in ``dense[b]`` and in ``most`` (row, block)."""

    at: np.ndarray
    example: np.ndarray
    value: np.ndarray
    column: np.ndarray
    dense: np.ndarray
    most: np.ndarray
    size: int
    n: int

    @classmethod
    def build(cls, row: np.ndarray, term: np.ndarray, x: np.ndarray, n: int, terms: int, size: int, frequent: float) -> Index:
        length = np.bincount(term, minlength=terms)
        often = np.flatnonzero(length > frequent * n)
        column = np.full(terms, -1, np.int32)
        column[often] = np.arange(len(often))
        blocks = -(-n // size)
        dense = np.zeros((blocks, len(often), size), np.float32)
        own = column[term] >= 0
        dense[row[own] // size, column[term[own]], row[own] % size] = x[own]
        order = np.lexsort((row[~own], term[~own]))
        at = np.concatenate([[0], np.cumsum(np.where(column >= 0, 0, length))])
        return cls(at, row[~own][order].astype(np.int32), x[~own][order].astype(np.float32), column, dense, dense.max(2).T.copy() if blocks else np.zeros((len(often), 0), np.float32), size, n)

    def nearest(self, row: np.ndarray, term: np.ndarray, x: np.ndarray, rows: int, k: int, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and examples of the k nearest of each of some rows (cosine 0 fills up). ``but``: an example each row leaves out."""
        scale, shift, blocks = 1_000_000, 1 << 24, len(self.dense)
        rare = self.column[term] < 0
        length = (self.at[term + 1] - self.at[term])[rare]
        which, place = W.segments(length)
        place = place + self.at[term[rare]][which]
        width = blocks * self.size
        cos = np.bincount(row[rare][which] * width + self.example[place], x[rare][which] * self.value[place], minlength=rows * width).reshape(rows, blocks, self.size)
        q = np.zeros((rows, self.dense.shape[1]), np.float32)
        q[row[~rare], self.column[term[~rare]]] = x[~rare]
        bound = cos.max(2, initial=0) + q @ self.most
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, 1)
        best = np.zeros((rows, k), np.int64)  # cosine and example in one number, the earlier example the larger
        going = np.arange(rows)
        for r in range(blocks):
            going = going[(bound[going, r] > 0) & (np.round(bound[going, r] * scale + 8) * shift >= best[going].min(1))]
            if not len(going):
                break
            block = order[going, r]
            for b in np.unique(block).tolist():
                own = going[block == b]
                near = np.round((cos[own, b] + q[own] @ self.dense[b]) * scale).astype(np.int64)
                example = b * self.size + np.arange(self.size)
                key = np.where(near > 0, near * shift + (shift - 1 - example), 0)
                if but is not None:
                    key[example[None, :] == but[own][:, None]] = 0
                both = np.concatenate([best[own], key], 1)
                best[own] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        best = -np.sort(-best, axis=1)
        return best // shift / scale, np.where(best > 0, shift - 1 - best % shift, -1)


@dataclass
class Model:
    vocabulary: np.ndarray
    weight: np.ndarray
    index: Index | None
    labels: np.ndarray
    ids: np.ndarray
    base: float
    curve: tuple[float, float]
    k: int

    def votes(self, cos: np.ndarray, example: np.ndarray) -> np.ndarray:
        y = np.where(example >= 0, self.labels[np.maximum(example, 0)], 0)
        return (cos * y).sum(1) / np.maximum(cos.sum(1), 1e-9)

    def nearest(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Cosines of the nearest examples of each text, and the examples."""
        text, term, n = counts(col, self.vocabulary)
        return self.index.nearest(text, term, weigh(text, term, n, self.weight, len(col)), len(col), self.k)

    def score(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Scores and the examples nearest to each text."""
        if self.index is None:
            return np.full(len(col), self.base), np.full((len(col), self.k), -1)
        cos, example = self.nearest(col)
        z = self.curve[0] * self.votes(cos, example) + self.curve[1]
        return np.where(cos[:, 0] > 0, 1 / (1 + np.exp(-z)), self.base), example


def _logistic(v: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that make votes into chances (Newton's method, slightly damped)."""
    x, w = np.stack([v, np.ones_like(v)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + 1e-3 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, g)
    return float(w[0]), float(w[1])


def _columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a bounded result."""
    rows = df.toArrow()
    return [rows.column(c).to_numpy() for c in rows.column_names]


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, p: Toxic = Toxic()) -> Model:
    """Learn from labelled rows that are not held out; term frequencies come from all documents."""
    ship_package(docs.sparkSession)
    marked = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    share = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(share.values())
    base = share.get(1, 0) / total if total else 0.0
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), None, np.zeros(0), np.zeros(0, np.int64), base, (1.0, 0.0), p.k)
    if len(share) < 2:
        return empty
    pick = [marked.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.per_label) for y in (0, 1)]
    sample = pick[0].unionByName(pick[1])  # at most 2 * per_label rows
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    texts = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            word, text = words(b.column("text"))
            order = np.argsort(text, kind="stable")
            word, text = word[order], text[order]
            y = np.asarray(b.column("toxic"))
            for i in range(b.num_rows):
                own, n = np.unique(word[np.searchsorted(text, i) : np.searchsorted(text, i, "right")], return_counts=True)
                kin = np.uint64(0)  # of the four least hashes, which near copies mostly share: they count once
                for h in np.sort(W.mix(own.copy()))[:4]:
                    kin = W.mix(np.array([kin ^ h]))[0]
                cols = [np.full(len(own), v) for v in (b.column("doc_id")[i].as_py(), y[i], kin.view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*cols, own.view(np.int64), n)], ["doc_id", "toxic", "kin", "term", "n"])

    found = cut(texts.mapInArrow(W.tidy(terms), "doc_id long, toxic int, kin long, term long, n long"))
    n = {r["toxic"]: r["n"] for r in found.groupBy("toxic").agg(F.countDistinct("kin").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return empty
    both = found.select("term", "toxic", "kin").distinct().groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    c, d = n1 - a, n0 - b  # of texts that are no near copies
    phi = F.pow(F.greatest(F.abs(a * d - b * c) - (n1 + n0) / 2, F.lit(0.0)), 2) / ((a + b) * F.greatest(c + d, F.lit(1.0)) * n1 * n0)
    every, phi = _columns(both.select("term", phi.alias("phi")))  # the words of at most 2 * per_label texts
    own = np.argsort(every.view(np.uint64))
    vocabulary, phi = every.view(np.uint64)[own], phi[own]

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(len(vocabulary), np.int64), 0
        for b in W.slices(batches):
            df += np.bincount(counts(b.column("text"), vocabulary)[1], minlength=len(vocabulary))
            rows += b.num_rows
        own = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1), pa.int64()), pa.array(np.append(df[own], rows), pa.int64())], ["term", "n"])

    df = docs.select(F.col("text").cast("string")).mapInArrow(W.tidy(frequencies), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    total_df = np.zeros(len(vocabulary) + 1)  # the last is the number of documents
    term, n = _columns(df)
    total_df[term] = n
    weight = np.log((1 + total_df[-1]) / (1 + total_df[:-1])) * phi

    doc, label, term, n = _columns(found.select("doc_id", "toxic", "term", "n"))
    term = np.searchsorted(vocabulary, term.view(np.uint64))
    ids, row = np.unique(doc, return_inverse=True)
    y = np.zeros(len(ids))
    y[row] = label
    x = weigh(row, term, n, weight, len(ids))
    known = np.bincount(row, x > 0, minlength=len(ids)) > 0
    if not known.any():
        return empty
    order = np.lexsort((term, -x, row))  # each example's heaviest term comes first
    heaviest = term[order[np.concatenate([[0], np.flatnonzero(np.diff(row[order])) + 1])]]
    place = np.empty(len(ids), np.int64)
    place[np.lexsort((ids, heaviest, y))] = np.arange(len(ids))  # like examples share blocks
    ids, y, known, row = ids[np.argsort(place)], y[np.argsort(place)], known[np.argsort(place)], place[row]
    model = Model(vocabulary, weight, Index.build(row, term, x, len(ids), len(vocabulary), p.block, p.frequent), y, ids, base, (1.0, 0.0), p.k)
    cos, example = np.zeros((len(ids), p.k)), np.full((len(ids), p.k), -1)
    order = np.argsort(row, kind="stable")
    row, term, x = row[order], term[order], x[order]
    for i in range(0, len(ids), ROWS):
        m, (lo, hi) = min(ROWS, len(ids) - i), np.searchsorted(row, [i, i + ROWS])
        cos[i : i + m], example[i : i + m] = model.index.nearest(row[lo:hi] - i, term[lo:hi], x[lo:hi], m, p.k, but=np.arange(i, i + m))
    drawn = min(share[0], p.per_label), min(share[1], p.per_label)
    weight = np.where(y == 1, share[1] / drawn[1], share[0] / drawn[0])
    model.curve = _logistic(model.votes(cos, example)[known], y[known], weight[known] * known.sum() / weight[known].sum())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` (ids of the nearest examples) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part.slice(i, ROWS) for part in W.slices(batches, block=1 << 21) for i in range(0, part.num_rows, ROWS)):
            s, example = model.score(b.column("text"))
            near = [model.ids[e[e >= 0]] for e in example]
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32)), pa.array(near, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "score", "predicted", "evidence"])

    ship_package(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("held_out", held_out())
    return d.mapInArrow(W.tidy(run), RESULT)
