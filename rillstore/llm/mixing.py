"""Mixing sources to target weights with soft membership.

A softmax classifier over hashed words, fitted to a bounded sample of the labelled table, gives every
document its chances of belonging to each domain. A document's rate is how often it is expected in
the mix. The rates minimise the squared distance, in units of the targets, between the expected token
totals of the domains and the targets, over nonnegative rates, and stay as near to 1 as that allows. Such
rates are 1 less the chances times one number a domain, projected on the bound; these numbers are found by
Newton's method: every step sums rate x tokens x chances, and their products over the documents off the bound,
where they are, and only these sums move. The targets' sum is that of the documents' tokens, so the mix is as
large as the corpus. With ``least`` above 0 no rate falls below it; the targets' sum is then so large that no
wanted domain need shrink, and the mix grows by what the scarcest domain needs.

Tokens are those of a tokenizers file, or words where none is given. Totals that miss the targets, and wanted
domains without a labelled document (left out, the others' weights made to sum to 1), are reported by a warning.

Defined results: a null or empty text has no tokens and the chances of the sample's shares; a domain of
weight 0 is emptied as far as chances allow (not with ``least``); repeated rows are rated each on their own;
documents without ``doc_id`` get the copies of id 0; without a labelled sample every domain is equally likely;
an empty table gives no rows; labels without a document, or without an id, are passed over; extra columns are
kept by :func:`apply`, whatever their names, and not read by :func:`mix`.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstore.cluster import cut, fresh, ship_package
from rillstore.llm import words as W


@dataclass(frozen=True)
class Mix:
    sample: int = 3000  # labelled documents that are fitted: those of least hash
    slots: int = 4096
    steps: int = 60
    close: float = 1e-4  # stop when the totals are as near to the targets, relatively
    least: float = 0.0  # no rate is lower; 1 keeps every document
    margin: float = 0.02  # with ``least``: by how much the scarcest total is raised, so that rates stay off their bound


@dataclass
class Classifier:
    domains: list[str]
    weight: np.ndarray  # slot, domain
    bias: np.ndarray
    seen: tuple[str, ...] = ()  # domains with a labelled document

    def chances(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and its chances."""
        data, at = W.flat(col)
        s, e, first = W.find(data, at, W.LETTERS)
        slot = (W.hashes(data, s, e, lower=True) % np.uint64(len(self.weight))).astype(np.int64)
        total = np.concatenate([np.zeros((1, len(self.domains))), np.cumsum(self.weight[slot], 0, dtype=np.float64)])
        n = np.diff(first)
        z = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)[:, None] + self.bias
        z = np.exp(z - z.max(1, keepdims=True))
        spaced = np.diff(W.find(data, at)[2])
        return spaced, z / z.sum(1, keepdims=True)


def fit_classifier(docs: DataFrame, labels: DataFrame, domains: list[str], domain: str = "lang", p: Mix = Mix()) -> Classifier:
    """Softmax regression of the ``domain`` column on word frequencies, on labelled documents."""
    ship_package(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long")).filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col(domain).alias("domain")).join(F.broadcast(known), "doc_id").filter(F.col("domain").isin(domains))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            data, at = W.flat(b.column("text"))
            s, e, first = W.find(data, at, W.LETTERS)
            slot = (W.hashes(data, s, e, lower=True) % np.uint64(p.slots)).astype(np.int64)
            for i in range(b.num_rows):
                x = (np.bincount(slot[first[i] : first[i + 1]], minlength=p.slots) / max(1, first[i + 1] - first[i])).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column("domain").slice(i, 1), b.column("doc_id").slice(i, 1), pa.array([x.tobytes()], pa.binary())], ["domain", "doc_id", "x"])

    rows = sorted(own.mapInArrow(W.tidy(vectors), "domain string, doc_id long, x binary").collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))  # at most ``sample`` vectors
    k = len(domains)
    if not rows:
        return Classifier(domains, np.zeros((p.slots, k)), np.zeros(k))
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in rows])
    y = np.eye(k, dtype=np.float32)[[domains.index(r["domain"]) for r in rows]]
    share = (y.sum(0) + 0.5) / (len(y) + 0.5 * k)
    w, bias = np.zeros((p.slots, k), np.float32), np.log(share)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 201):  # Adam on the weights; the intercept stays at the shares
        z = x @ w + bias
        z = np.exp(z - z.max(1, keepdims=True))
        g = x.T @ ((z / z.sum(1, keepdims=True) - y) / len(y)).astype(np.float32) + 1e-7 * w
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        w -= (1.0 * first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-7)
    return Classifier(domains, w, bias, tuple(d for d, n in zip(domains, y.sum(0), strict=True) if n))


def rates(chances: np.ndarray, steps: list[np.ndarray], least: float) -> np.ndarray:
    """Rates after some projected steps, from 1."""
    r = np.ones(len(chances))
    for z in steps:
        r = np.maximum(least, r - chances @ z)
    return r


def _memberships(c: Classifier, tokenizer: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rillstore.llm.pieces import pieces

        for b in W.slices(batches, block=1 << 21):
            n, p = c.chances(b.column("text"))
            if tokenizer is not None:
                n = pieces(tokenizer).token_counts(b.column("text"))
            lists = pa.ListArray.from_arrays(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), lists], ["doc_id", "n_tokens", "chances"])

    return run


def _unlist(col: pa.Array, k: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, k)


def memberships(docs: DataFrame, c: Classifier, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, chances`` of every row."""
    d = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return d.mapInArrow(W.tidy(_memberships(c, tokenizer)), "doc_id long, n_tokens long, chances array<double>")


def sums(n: np.ndarray, own: np.ndarray, z: np.ndarray, least: float) -> np.ndarray:
    """Of some documents, after the step ``z``: totals, products of chances off the bound, and the cost whose slope is minus the totals."""
    r, free = rates(own, [z], least), 1 - own @ z > least
    free |= not z.any()  # where no rate has moved, the bound does not hold yet
    cost = n @ np.where(free, r * r / 2, least * (1 - own @ z) - least**2 / 2)
    return np.concatenate([(r * n) @ own, ((own * (n * free)[:, None]).T @ own).ravel(), [cost]])


def solve(at: Callable[[np.ndarray], np.ndarray], weight: np.ndarray, p: Mix = Mix()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The projected step, the totals it reaches, and the targets; ``at`` gives :func:`sums` over all documents."""
    k = len(weight)
    split = lambda x: (x[:k], x[k:-1].reshape(k, k), x[-1])
    z = np.zeros(k)
    now, gram, cost = split(at(z))
    if not now.sum():
        return z, now, now
    wanted = weight > 0
    target = weight * (now.sum() if p.least == 0 else p.least * (1 + p.margin) * (now[wanted] / weight[wanted]).max())
    # Squared distances weigh so much more than the distance of the rates from 1 that the latter only settles ties.
    tie = 1e-9 * np.maximum(target, 1e-3 * target.sum())
    for _ in range(p.steps):
        slope = target - now + tie * z
        if np.abs(slope).max() <= 0.01 * p.close * target.max():
            break
        move = -np.linalg.solve(gram + np.diag(tie), slope)
        share = 1.0
        while share > 1e-9:  # halved until the cost falls
            y = z + share * move
            new, new_gram, new_cost = split(at(y))
            if new_cost - cost + target @ (y - z) + tie @ (y * y - z * z) / 2 <= 1e-4 * share * (slope @ move):
                break
            share /= 4
        else:
            break
        z, now, gram, cost = y, new, new_gram, new_cost
    return z, now, target


def fit_rates(members: DataFrame, targets: Mapping[str, float], c: Classifier, p: Mix = Mix()) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The projected step, the expected token totals it reaches, and the targets in tokens."""
    domains, k = c.domains, len(c.domains)
    weight = np.array([max(0.0, targets[d]) for d in domains], float)
    lost = [d for d, w in zip(domains, weight, strict=True) if w and c.seen and d not in c.seen]
    if lost:
        warnings.warn(f"no labelled document of {', '.join(lost)}: left out of the mix", stacklevel=2)
        weight[[domains.index(d) for d in lost]] = 0
    if not weight.sum():
        raise ValueError("a domain with labelled documents and a weight above 0 is needed")
    weight /= weight.sum()

    def at(z: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k + k * k + 1)
            for b in batches:
                out += sums(np.asarray(b.column("n_tokens")).astype(float), _unlist(b.column("chances"), k), z, p.least)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["i", "x"])

        out = np.zeros(k + k * k + 1)
        for r in members.select("n_tokens", "chances").mapInArrow(W.tidy(run), "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            out[r["i"]] = r["x"]
        return out

    z, now, target = solve(at, weight, p)
    if now.sum() and np.abs(now - target).max() > p.close * target.max():
        reached = ", ".join(f"{d} {a / now.sum():.4f} of {w:.4f}" for d, a, w in zip(domains, now, weight, strict=True))
        warnings.warn(f"the mix does not reach its targets; shares of tokens: {reached}", stacklevel=2)
    return ([z] if z.any() else []), now, target


def copies(rate, doc_id):
    """The rate, rounded up or down by chance fixed by the id."""
    u = F.pmod(F.xxhash64(F.coalesce(doc_id, F.lit(0)), F.lit("copies")), F.lit(1 << 32)) / float(1 << 32)
    return F.floor(rate + u).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], p: Mix = Mix(), tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, domain, chances, rate, copies`` of every row."""
    domains = sorted(targets)
    c = fit_classifier(docs, labels, domains, p=p)
    members = cut(memberships(docs, c, tokenizer))
    steps, _, _ = fit_rates(members, targets, c, p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = _unlist(b.column("chances"), len(domains))
            names = pa.array([domains[i] for i in own.argmax(1)], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, names, pa.array(rates(own, steps, p.least))], ["doc_id", "n_tokens", "chances", "domain", "rate"])

    out = members.mapInArrow(W.tidy(run), "doc_id long, n_tokens long, chances array<double>, domain string, rate double")
    return out.withColumn("copies", copies(F.col("rate"), F.col("doc_id")))


def apply(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float], p: Mix = Mix(), tokenizer: str | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as its copies; all columns as they are.

    Chances are computed again where the texts are, so no text is shuffled.
    """
    c = fit_classifier(docs, labels, sorted(targets), p=p)
    members = cut(memberships(docs, c, tokenizer))
    steps, _, _ = fit_rates(members, targets, c, p)
    rate = fresh(docs, "rate")
    d = docs.withColumn(rate, F.lit(1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches):
            r = rates(c.chances(b.column("text"))[1], steps, p.least)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(r)], b.schema.names)

    d = d.mapInArrow(W.tidy(run), d.schema)
    again = F.array_repeat(F.lit(1), copies(F.col(rate), F.col("doc_id").cast("long")))
    return d.withColumn(rate, F.explode(again)).select(*[f"`{x}`" for x in docs.columns])
