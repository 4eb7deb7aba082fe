"""Phrase collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import collocations as K

SCHEMA = "doc_id long, text string, lang string, rank string, phrase string, n string, words string, _t string, _lang string"
LOWER = str.maketrans(K.UPPER, K.UPPER.lower())


def counted(rows, longest):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, longest=3, least=10, share=50, top=2000):
    f, n = counted(rows, longest)
    found = {(lang, p): a for (lang, p), a in f.items() if len(p) > 1 and a >= least}
    holders = defaultdict(list)
    for (lang, q), b in found.items():
        for k in range(2, len(q)):
            for i in range(len(q) - k + 1):
                holders[lang, q[i : i + k]].append(b)
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if all(100 * b < share * a for b in holders[lang, p]):
            score, _, left, right = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


def corpus(seed):
    rnd = random.Random(seed)
    words = ["The", "the", "of", "new", "York", "city", "Ä", "ä", "x y", "\x00", "漢", "a-b"]
    text = lambda: "".join(rnd.choice(words) + rnd.choice((" ", " ", "  ", "\t", ", ", "\n", ".", "\x0b")) for _ in range(rnd.randrange(60)))
    rows = [(text(), rnd.choice(("en", "de", None, "und", ""))) for _ in range(60)]
    return [*rows, *rows[:7], (None, "en"), ("", "xx"), (" \t\n..", "en"), ("New York City " * 3000, "en"), ("one", "zz"), ("ab " * 40, "de")]


@pytest.mark.parametrize(("longest", "least", "share", "top"), [(3, 10, 50, 2000), (4, 2, 80, 5), (2, 1, 50, None), (5, 3, 100, 2000)])
def test_equal_to_plain_counting(spark, monkeypatch, longest, least, share, top):
    monkeypatch.setattr(K, "SHARD_BYTES", 700)
    monkeypatch.setattr(K, "ROWS", 50)
    rows = corpus(longest)
    df = spark.createDataFrame([(1, t, lang, *"rpnwtl") for t, lang in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in K.collocations(df, longest=longest, least=least, share=share, top=top).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, longest, least, share, 10**9 if top is None else top)


def test_empty_tables_and_texts(spark):
    df = spark.createDataFrame([(1, None, None, *"rpnwtl"), (2, ". .", "en", *"rpnwtl")], SCHEMA)
    assert K.collocations(df).count() == 0 and K.collocations(df.limit(0)).count() == 0


def test_the_automaton_has_every_substring_once():
    rows = corpus(9)
    a = K.Automaton(pa.array([(t or "").encode() for t, _ in rows], pa.binary()), pa.array(["und" if x is None else x for _, x in rows]), 4)
    f, _ = counted(rows, 4)
    got, spelled = {}, []
    for d in range(1, 5):
        every = np.arange(len(a.levels[d - 1].count))
        phrases, langs = a.phrases(d, every).to_pylist(), a.languages(d, every).to_pylist()
        spelled.append(phrases)
        got |= {(lang, tuple(p.split(" "))): n for lang, p, n in zip(langs, phrases, a.levels[d - 1].count.tolist(), strict=True)}
        assert len(set(zip(langs, phrases, strict=True))) == len(every) == len(set(a.levels[d - 1].hash.tolist()))
        if d > 1:  # transitions drop the last word, suffix links the first
            for s, up, link in zip(phrases, a.levels[d - 1].parent, a.levels[d - 1].link, strict=True):
                w = s.split(" ")
                assert spelled[d - 2][up] == " ".join(w[:-1]) and spelled[d - 2][link] == " ".join(w[1:])
    assert got == dict(f)


def test_scores_beyond_64_bits(spark):
    """The same decimal arithmetic on counts near 10^15."""
    row = spark.sql("SELECT CAST(999999999999999 AS DECIMAL(15,0)) * CAST(999999999999999 AS DECIMAL(15,0)) * CAST(1000000 AS DECIMAL(7,0)) div (CAST(999999999999999 AS DECIMAL(15,0)) * CAST(999999999999999 AS DECIMAL(15,0))) AS s").first()
    assert row.s == 1_000_000


def test_states_are_made_for_what_may_be_frequent_only():
    """With a filter of some bigrams: these, and the trigrams whose parent and suffix link are among them."""
    rows = corpus(5)
    texts, langs = pa.array([(t or "").encode() for t, _ in rows], pa.binary()), pa.array(["und" if x is None else x for _, x in rows])
    full = K.Automaton(texts, langs, 3)
    some = full.levels[1].hash[full.levels[1].count >= 10]

    class Exact:
        def has(self, h):
            return np.isin(h, some)

    a, may = K.Automaton(texts, langs, 3, Exact(), 2), np.isin(full.levels[1].hash, some)
    want = [np.flatnonzero(may), np.flatnonzero(may[full.levels[2].parent] & may[full.levels[2].link])]
    for d, x in zip((2, 3), want, strict=True):
        assert 0 < len(x) < len(full.levels[d - 1].count)
        assert dict(zip(full.levels[d - 1].hash[x].tolist(), full.levels[d - 1].count[x].tolist(), strict=True)) == dict(zip(a.levels[d - 1].hash.tolist(), a.levels[d - 1].count.tolist(), strict=True))
    assert set(a.levels[2].parent.tolist()) | set(a.levels[2].link.tolist()) <= set(range(len(a.levels[1].count)))


def test_buckets_are_summed_whole(monkeypatch):
    monkeypatch.setattr(K, "GROUP", 1)
    schema = pa.schema({"bucket": pa.int32(), "h": pa.list_(pa.int64()), "m": pa.list_(pa.int64()), "lang": pa.list_(pa.string()), "phrase": pa.list_(pa.string()), "n": pa.list_(pa.int64())})
    batch = lambda *b: pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in b], schema)
    out = pa.Table.from_batches(K.summed(iter([batch((0, [-5, 7], [1, 2], ["en"], [None], [4])), batch((0, [7], [2**53 + 1], ["en"], [None], [5]), (1, [], [], [], [], []), (3, [9], [1], ["de", "en"], ["a", "a"], [1, 2]))])))
    assert sorted(map(str, map(tuple, (r.values() for r in out.to_pylist())))) == sorted(map(str, [(None, None, -5, 1), (None, None, 7, 2**53 + 3), ("en", None, None, 9), (None, None, 9, 1), ("de", "a", None, 1), ("en", "a", None, 2)]))
    assert list(K.summed(iter([]))) == []
