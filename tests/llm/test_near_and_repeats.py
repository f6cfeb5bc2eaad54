import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillstore.llm import minhash, repeats
from rillstore.llm import words as W

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, k):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute_components(docs, k, percent):
    sets = {d: shingle_set(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def corpus(seed, groups=12, copies=12):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.randrange(1, copies)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary).upper()
            docs.append(rng.choice([" ", "\n", "\t "]).join(own))
    rng.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("k, rounds, few", [(4, 3, 1000), (5, 1, 0)])
def test_components_equal_brute_force(spark, k, rounds, few):
    docs = corpus(k)
    p = minhash.Near(k=k, star_rounds=rounds, few=few)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.components(spark.createDataFrame(docs, "doc_id long, text string"), p).collect()}
    assert got == brute_components(docs, k, 80)


def test_components_edge_cases(edge, none):
    rows = [tuple(r) for r in minhash.components(edge).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    got = {r[0]: r[1:] for r in rows if r[0] is not None}
    assert got[1] == (9, 1, True) and got[8] == (9, 1, False) and rows.count((8, 9, 1, False)) == 2
    assert got[2] == got[2] == (0, 2, True) and got[3] == (0, 3, True) and got[4] == (0, 4, True) and got[5][0] == 1 and got[6][0] == 1
    assert got[7][0] > 30_000
    assert [r[2:] for r in rows if r[0] is None] == [(None, True)] * 2
    assert minhash.components(none).collect() == []


def test_rows_of_one_id_count_by_their_smallest_text(spark):
    t = "a b c d e f g h i j"
    df = spark.createDataFrame([(1, t), (2, t), (2, "z z z z z z"), (3, "z z z z z z")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"]) for r in minhash.components(df).collect()) == [(1, 1), (2, 1), (2, 1), (3, 3)]


def test_sketches_fill_and_estimate():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 2, 7, 50, 300, 0])
    items = np.concatenate([rng.integers(0, 2**63, n).astype(np.uint64) for n in sizes])
    s = minhash.sketch(items, sizes, 64)
    assert (s[:5] != np.uint64(2**64 - 1)).all() and (s[5] == np.uint64(2**64 - 1)).all()
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    both = minhash.sketch(np.concatenate([a[:900], a[100:]]), np.array([900, 900]), 1024)
    assert abs((both[0] == both[1]).mean() - 0.8) < 0.06


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=80), st.sets(st.integers(0, 2**64 - 1), max_size=80), st.sets(st.integers(0, 2**64 - 1), max_size=80))
def test_parities_never_exceed_the_difference(common, a, b):
    x, y = common | a, common | b
    items = np.array([*sorted(x), *sorted(y)], np.uint64)
    bits = minhash.parities(items, np.array([len(x), len(y)]))
    assert sum(int(v).bit_count() for v in (bits[0] ^ bits[1]).view(np.uint64)) <= len(x ^ y)


def test_connected_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in minhash.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x0b\x1c ", max_size=30)), max_size=8))
def test_words_equal_the_pattern(texts):
    import pyarrow as pa

    data, at = W.flat(pa.array(texts, pa.string()))
    s, e, first = W.find(data, at)
    raw = data.tobytes()
    got = [[raw[a:b].decode() for a, b in zip(s[i:j], e[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
    assert got == [WORDS.findall(t or "") for t in texts]
    h = W.hashes(data, s, e)
    flat = [w for t in got for w in t]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


def brute_repeats(docs, length):
    seen, out = set(), {}
    for d, t in sorted(docs):
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            g = tuple(w[i : i + length])
            if g in seen:
                gone[i : i + length] = [True] * length
            seen.add(g)
        kept = " ".join(x for x, y in zip(w, gone, strict=True) if not y)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("seed, length, anchor, letters", [(1, 20, 6, 40), (2, 5, 2, 3), (3, 4, 4, 2), (4, 20, 3, 2), (5, 7, 1, 2)])
def test_repeats_equal_brute_force(spark, seed, length, anchor, letters):
    rng = random.Random(seed)
    passages = [[f"v{rng.randrange(letters)}" for _ in range(rng.choice([3, length, length + 1, 60]))] for _ in range(12)]
    docs = []
    for i in range(80):
        own = []
        for _ in range(rng.randrange(0, 6)):
            own += rng.choice(passages) if rng.random() < 0.6 else [f"v{rng.randrange(letters)}" for _ in range(rng.randrange(1, 30))]
        docs.append((i * 7, rng.choice([" ", "\n  "]).join(own)))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length, anchor).collect()}
    assert got == brute_repeats(docs, length)


def test_repeats_edge_cases(edge, none):
    rows = repeats.remove_repeats(edge).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in rows if r["doc_id"] is not None}
    assert got[2] == got[3] == got[4] == (0, 0) and got[5] == (1, 0) and got[7] == (33_000, 2999)
    assert sum(r["doc_id"] == 8 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 2
    assert {r["kept_text"] for r in rows if r["doc_id"] is None} == {"no id here at all", ""}
    assert repeats.remove_repeats(none).collect() == []
    with pytest.raises(ValueError):
        repeats.remove_repeats(none, 50, 6)
