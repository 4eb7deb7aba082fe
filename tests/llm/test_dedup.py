"""Exact, near and substring dedup against brute force, with nulls, ties, repeated rows and odd columns."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from factloom.llm import exact_dedup as E
from factloom.llm import simhash as S
from factloom.llm import substring_dedup as D

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, _norm string, size string, fp string"


def corpus(seed=7):
    """Copies, near copies, passages, cycles, white space of all kinds, nulls and one long text."""
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Äpfel", "ÉT", "İx", "a b", "A"]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = text(30)
    base = [text(rnd.choice((0, 1, 3, 4, 25, 60, 120))) for _ in range(40)]
    out = [None, "", " \t\n", "one", "One", "a  b", "a b", "a\tb ", passage, text(3000), "x " * 400, "p q r " * 60]
    out += base + base[:10] + [b.replace(" ", "  ", 3) for b in base[:5]] + [f"{text(9)} {passage} {text(15)}" for _ in range(6)]
    for b in base:
        w = b.split(" ")
        if len(w) > 50:
            w[rnd.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    rows = [(k, t) for k, t in enumerate(out)]
    rnd.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, 3, "key", "norm", "s", "f") for i, t in rows], SCHEMA).repartition(3)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("digest", [F.md5, lambda c: F.substring(F.md5(c), 1, 1), lambda c: F.lit("same")])
def test_exact_dedup(spark, digest):
    """Colliding hashes change nothing: bytes decide."""
    rows = corpus()
    got = {r[0]: tuple(r)[1:] for r in E.exact_dedup(frame(spark, rows), digest=digest).collect()}
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert got == want
    kept = E.keep_first_copies(frame(spark, rows), digest=digest)
    assert kept.columns == SCHEMA.replace(" string", "").replace(" long", "").split(", ")
    assert sorted((r.doc_id, r.text, r._norm) for r in kept.collect()) == sorted((min(g), dict(rows)[min(g)], "norm") for g in groups.values())


def test_exact_dedup_of_repeated_rows_and_null_ids(spark):
    rows = [(5, "a"), (5, "a"), (7, "a"), (None, "a"), (None, "b"), (None, "b"), (1, None), (2, "")]
    got = sorted(tuple(r)[:4] for r in E.exact_dedup(frame(spark, rows)).select(F.coalesce("doc_id", F.lit(-1)), F.coalesce("keep_id", F.lit(-1)), "group_size", "kept").collect())
    assert got == [(-1, -1, 2, False), (-1, -1, 2, True), (-1, 5, 4, False), (1, 1, 2, True), (2, 1, 2, False), (5, 5, 4, False), (5, 5, 4, True), (7, 5, 4, False)]
    assert sorted((r.doc_id or -1, r.text or "") for r in E.keep_first_copies(frame(spark, rows)).collect()) == [(-1, "b"), (1, ""), (5, "a")]


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, linked):
    up = {v: v for v in values}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    order = sorted(values)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {v: find(v) for v in values}


def test_near_duplicates(spark):
    rows = corpus()
    fps = {i: fingerprint(t) for i, t in rows}
    root = components(set(fps.values()), lambda a, b: (a ^ b).bit_count() <= 4)
    low = {}
    for i, f in fps.items():
        low[root[f]] = min(low.get(root[f], i), i)
    got = {r[0]: (r[1], r[2]) for r in S.near_duplicates(frame(spark, rows)).collect()}
    assert got == {i: (f"{f:016x}", low[root[f]]) for i, f in fps.items()}
    kept = S.keep_one_of_each(frame(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(low.values())) and kept.columns[-1] == "fp"


@pytest.mark.parametrize("kind", ["random", "correlated", "dense"])
def test_links_lose_no_component(spark, kind):
    """Fingerprints at random, with bits that go together, and in one ball of near copies."""
    rnd = random.Random(3)
    flip = lambda x, n: x ^ sum(1 << b for b in rnd.sample(range(64), n))
    seeds = [rnd.getrandbits(64) for _ in range(60)]
    if kind == "correlated":
        seeds = [(0xFFFFFFFF if rnd.random() < 0.5 else 0) << 32 | rnd.getrandbits(12) for _ in range(150)]
    fps = {flip(s, rnd.randrange(6)) for s in seeds for _ in range(4)} | ({flip(seeds[0], rnd.randrange(5)) for _ in range(700)} if kind == "dense" else set())
    df = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in fps], "fp long").repartition(3)
    links = [(a % 2**64, b % 2**64) for a, b in S.links(df).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    if kind == "dense":
        assert len(links) < 40 * len(fps)
    have = {frozenset(x) for x in links}
    assert components(fps, lambda a, b: frozenset((a, b)) in have) == components(fps, lambda a, b: (a ^ b).bit_count() <= 4)


def removed(rows, n=20):
    docs = sorted((i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows)
    seen, out = set(), {}
    for i, w in docs:
        gone = set()
        for k in range(len(w) - n + 1):
            win = tuple(w[k : k + n])
            if win in seen:
                gone |= set(range(k, k + n))
            seen.add(win)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out


@pytest.mark.parametrize("common", [50_000, 0])
def test_substring_dedup(spark, monkeypatch, common):
    """With passages spread window by window as well."""
    monkeypatch.setattr(D, "COMMON", common)
    rows = corpus()
    got = {r[0]: tuple(r)[1:] for r in D.dedup(frame(spark, rows)).collect()}
    assert got == removed(rows)


def test_fm_index_counts():
    import numpy as np

    rnd = np.random.default_rng(1)
    text = np.r_[rnd.integers(1, 5, 3000), 0]
    index = D.FMIndex(text, 5)
    at = np.arange(0, 2900)
    which, lo, hi = index.matches(text, at, 6)
    found = dict(zip(which.tolist(), (hi - lo).tolist(), strict=True))
    raw = bytes(text.tolist())
    for k in at[::37].tolist():
        n = sum(raw.startswith(raw[k : k + 6], j) for j in range(len(raw)))
        assert found.get(k, 1) == n


@pytest.mark.parametrize("op", [E.exact_dedup, E.keep_first_copies, S.near_duplicates, S.keep_one_of_each, D.dedup])
def test_empty_table(spark, op):
    assert op(frame(spark, [])).count() == 0


def plain_components(links, nodes):
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    groups = {}
    for x in nodes:
        groups.setdefault(root(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("width,n", [(43, 3000), (14, 1500), (20, 3000)])
def test_large_buckets_lose_no_link(width, n):
    """Sparse and dense buckets, dealt out by groups of bits, have the components that comparing all pairs gives."""
    import numpy as np

    rng = np.random.default_rng(width)
    base = rng.integers(0, 2**width, n, dtype=np.uint64)
    every = np.unique(np.r_[base, base[: n // 3] ^ (np.uint64(1) << rng.integers(0, width, n // 3).astype(np.uint64))])
    mixed = rng.permutation(every)
    index, probes = mixed[: len(mixed) * 3 // 4], mixed[len(mixed) * 3 // 4 :]
    want = [(a, b) for a in index.tolist() for b in every[np.bitwise_count(every ^ np.uint64(a)) <= 4].tolist() if a != b]
    got = [tuple(x) for part in S.linked(index, probes, 4) for x in part.T.tolist()]
    assert all((a ^ b).bit_count() <= 4 for a, b in got)
    assert plain_components(got, every.tolist()) == plain_components(want, every.tolist())


def test_hot_buckets_are_dealt_out(spark):
    """All fingerprints share 24 bits, so a part has one bucket, and it is dealt out to many tasks; links between planted pairs are all found."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**40, 10_000, dtype=np.uint64))
    near = base[:500] ^ (np.uint64(1) << rng.integers(0, 40, 500).astype(np.uint64))
    every = np.unique(np.r_[base, near])
    df = spark.createDataFrame(pd.DataFrame({"fp": every.view(np.int64)})).repartition(8)
    found = S.links(df, parts=3, split=500).toArrow()
    pairs = {frozenset(p) for p in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)}
    roots = plain_components([tuple(p) for p in pairs], every.view(np.int64).tolist())
    of = {x: k for k, g in enumerate(roots) for x in g}
    assert all(of[int(a)] == of[int(b)] for a, b in zip(base[:500].view(np.int64), near.view(np.int64), strict=True))
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 4 for a, b in pairs)


def test_each_component_keeps_a_row_under_null_and_repeated_ids(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(60))
    rows = [(None, words(0), 1), (None, words(1), 1), (None, words(1), 1), (7, words(2), 1), (7, words(3), 1), (7, words(3), 2), (3, words(4), 1), (9, words(4), 1), (9, words(5), 1), (None, words(5), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    assert S.near_duplicates(docs).select("fingerprint").distinct().count() == 6
    kept = sorted(((r.doc_id, r.text, r.n) for r in S.keep_one_of_each(docs).collect()), key=str)
    assert kept == sorted([(None, words(0), 1), (None, words(1), 1), (7, words(2), 1), (7, words(3), 1), (3, words(4), 1), (9, words(5), 1)], key=str)
