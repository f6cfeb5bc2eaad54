"""Substring dedup: remove passages that occurred earlier in the corpus.

Seed: in every window of ``length`` words the smallest ``k``-gram hash is the window's anchor, so equal
windows have equal anchors in equal places. Neighbouring windows that share an anchor occurrence form
a run. Extend: each run carries a hash of all words its windows reach to the left and right of the
anchor. Runs are joined on the anchor; where anchor and extension are equal, all windows of the run
match those of the earliest such run. Where an anchor occurs with different extensions, the windows
of the earliest run of each extension are compared one by one. Windows that start earlier elsewhere
merge into maximal repeats, whose words go.

Repeats inside a document are found where its words are. Across documents every group is one aggregate
row, its first document, combined before the shuffle and joined back to the runs: no group is held or
paired, and a hot anchor's runs are split by the join.

Defined results: a null or empty text has no words; texts shorter than a window are kept whole; of
rows with the same ``doc_id`` the smallest text stands for all; rows without a ``doc_id`` are kept whole
and make nothing else a repeat; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstore.cluster import cut, ship_package
from rillstore.llm import words as W

LENGTH, ANCHOR = 20, 6
#: Bytes of text looked at at once.
BLOCK = 1 << 20
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
#: A run is one number: its first window, times 32, plus its number of windows (fewer than 32).
_SHIFT = 5


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return W.mix(x * np.uint64(0xD6E8FEB86659FD93) + y)


def gram_hashes(word: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each place on, by doubling."""
    n = len(word) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, size = None, 0, word, 1
    while True:
        if k & size:
            out = power if out is None else _join(out[: len(power) - have], power[have:]) if have else out
            have += size
        if size * 2 > k:
            return out[:n].copy()
        power = _join(power[: len(power) - size], power[size:])
        size *= 2


def _window_minimum(g: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost least value in each window of ``w``."""
    value, place, size = g, np.arange(len(g), dtype=np.int32), 1
    while size < w:
        step = min(size, w - size)
        a, b = value[: len(value) - step], value[step:]
        right = b < a
        value = np.where(right, b, a)
        place = np.where(right, place[step:], place[: len(place) - step])
        size += step
    return place


def runs(data: np.ndarray, at: np.ndarray, length: int, k: int):
    """Of each run: text, first window (as a word of its text), windows, anchor hash, extension hash.
    Also the window hashes, and the first word of each text."""
    s, e, first = W.find(data, at)
    word = W.hashes(data, s, e)
    window = gram_hashes(word, length)
    if not len(window):
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64), window, first
    gram = gram_hashes(word, k)
    anchor = _window_minimum(gram, length - k + 1)[: len(window)]
    own = np.zeros(len(window) + 1, bool)  # windows that lie in one text
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(window)]
    own[:-1] = np.arange(len(window)) + length <= first[1:][text]
    start = own[:-1].copy()
    start[1:] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    stop = own[:-1].copy()
    stop[:-1] &= (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | ~own[1:-1]
    a, b = np.flatnonzero(start), np.flatnonzero(stop)
    count = b - a + 1
    extension = _join(_join(window[a], window[b]), (count * 64 + anchor[a] - a).astype(np.uint64))
    return text[a], a - first[text[a]], count, gram[anchor[a]], extension, window, first


def _again(text: np.ndarray, *key: np.ndarray) -> np.ndarray:
    """Rows whose key occurs in an earlier row of the same text."""
    total = text.astype(np.uint64)
    for x in key:
        total = _join(total, x)
    order = np.argsort(total, kind="stable")
    same = np.ones(max(0, len(order) - 1), bool)
    for x in (text, *key):
        same &= x[order[1:]] == x[order[:-1]]
    out = np.zeros(len(text), bool)
    out[order[1:]] = same
    return out


def _seeds(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches, block=BLOCK):
            text, place, count, anchor, extension, _, _ = runs(*W.flat(b.column("text")), length, k)
            if len(text):
                doc = np.asarray(b.column("doc_id"))[text]
                cols = (anchor.view(np.int64), extension.view(np.int64), doc, place << _SHIFT | count, _again(text, anchor, extension))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["anchor", "extension", "doc_id", "run", "again"])

    return run


def _spread(run: np.ndarray) -> np.ndarray:
    """The windows of some runs."""
    n = run & ((1 << _SHIFT) - 1)
    which, place = W.segments(n)
    return (run >> _SHIFT)[which] + place


def _windows(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches, block=BLOCK):
            data, at = W.flat(b.column("text"))
            s, e, first = W.find(data, at)
            window = gram_hashes(W.hashes(data, s, e), length)
            lists = b.column("runs")
            sizes = np.diff(np.asarray(lists.offsets))
            own = np.asarray(lists.flatten())
            text = np.repeat(np.arange(len(sizes)), sizes)
            place, n = _spread(own), own & ((1 << _SHIFT) - 1)
            text = np.repeat(text, n)
            order = np.lexsort((place, text))
            text, place = text[order], place[order]
            doc, own = np.asarray(b.column("doc_id"))[text], window[first[text] + place]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(doc), pa.array(place << _SHIFT | 1), pa.array(_again(text, own))], ["window", "doc_id", "run", "again"])

    return run


def _remover(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in W.slices(batches, block=BLOCK):
            texts, lists = b.column("text").to_pylist(), b.column("runs")
            n_words, n_gone, sha, kept = [], [], [], []
            for i, t in enumerate(texts):
                words = (t or "").encode().split()  # bytes are parted at ASCII white space
                gone = 0
                own = lists[i]
                if own.is_valid and len(own.values):
                    r = np.asarray(own.values)
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, r >> _SHIFT, 1)
                    np.add.at(step, (r >> _SHIFT) + (r & ((1 << _SHIFT) - 1)) + length - 1, -1)
                    stays = np.cumsum(step[:-1]) == 0
                    n = len(words)
                    words = [words[j] for j in np.flatnonzero(stays).tolist()]
                    gone = n - len(words)
                text = b" ".join(words)
                n_words.append(len(words) + gone)
                n_gone.append(gone)
                sha.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode() if with_text else None)
            cols = [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in RESULT.split(", ")])

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """Each document without the words of windows of ``length`` words that start earlier.

    ``length`` is at most ``anchor + 31``. Columns: ``doc_id, n_words, n_removed, kept_sha256, kept_text``.
    """
    if not 0 < anchor <= length < anchor + 31:
        raise ValueError("anchor <= length < anchor + 31 is needed")
    ship_package(docs.sparkSession)
    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    d = whole.filter("doc_id is not null")
    repeated = bool(d.groupBy("doc_id").count().filter("count > 1").limit(1).count())
    if repeated:
        d = cut(d.groupBy("doc_id").agg(F.min("text").alias("text")))
    seeds = d.mapInArrow(W.tidy(_seeds(length, anchor)), "anchor long, extension long, doc_id long, run long, again boolean")

    # Anchors of several runs; those with one extension only are settled by the first document.
    several = seeds.filter("not again").groupBy("anchor").agg(F.min("extension").alias("lo"), F.max("extension").alias("hi"), F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    several = cut(several.drop("n"))  # written, so that the join reads both sides from shuffles and can split a hot anchor
    met = seeds.join(several, "anchor", "left").filter("again or lo <> hi or doc_id > first")
    met = cut(met.select("doc_id", "run", "extension", F.expr("if(again or lo = hi, null, anchor)").alias("anchor")))
    mixed = met.filter("anchor is not null")
    leads = cut(mixed.groupBy("anchor", "extension").agg(F.min("doc_id").alias("first")))
    mixed = cut(mixed.join(leads, ["anchor", "extension"]).select("doc_id", "run", (F.col("doc_id") == F.col("first")).alias("open")))

    # The windows of the first run of each extension, one by one.
    open_ = mixed.filter("open").groupBy("doc_id").agg(F.collect_list("run").alias("runs"))
    windows = cut(d.join(open_, "doc_id").mapInArrow(W.tidy(_windows(length, anchor)), "window long, doc_id long, run long, again boolean"))
    shared = windows.filter("not again").groupBy("window").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    more = windows.join(cut(shared.drop("n")), "window", "left").filter("again or doc_id > first").select("doc_id", "run")
    gone = met.filter("anchor is null").select("doc_id", "run").unionByName(mixed.filter("not open").select("doc_id", "run")).unionByName(more)
    gone = gone.groupBy("doc_id").agg(F.collect_list("run").alias("runs"))
    out = d.join(gone, "doc_id", "left").mapInArrow(W.tidy(_remover(length, with_text)), RESULT)
    if repeated:
        out = whole.select("doc_id").filter("doc_id is not null").join(cut(out), "doc_id")
    rest = whole.filter("doc_id is null").withColumn("runs", F.lit(None).cast("array<long>"))
    return out.unionByName(rest.mapInArrow(W.tidy(_remover(length, with_text)), RESULT))
