"""SentencePiece coding and the alignment of two tokenizers, against their libraries."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from factloom.llm import alignment as A
from factloom.llm import sentencepiece_codec as C

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CHARS = list("ab e\t\n▁  the<s></s><0x41>éß漢字😀́\x00 ing'.")
SCHEMA = "doc_id long, text string, ids string, decoded string, n_tokens string, _id string, _t string"


@pytest.fixture(scope="module")
def words():
    with open(MODEL, "rb") as f:
        return C.Vocabulary(f.read())


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def strange(seed, n, most=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(CHARS) for _ in range(rnd.randrange(most))) for _ in range(n)]


def test_ids_and_texts_are_the_librarys(words, library):
    texts = strange(1, 3000) + ["x" * 5000, " " * 700, "▁" * 90, "thequickbrownfox" * 2000, "漢" * 300]
    packed = words.encode(texts, True, True, library)
    assert [C.ids_of(p) for p in packed] == library.encode(texts, add_bos=True, add_eos=True)
    assert [words.decode(np.frombuffer(p, "<u4")) for p in packed] == library.decode([C.ids_of(p) for p in packed])


def test_any_ids_are_decoded_as_by_the_library(words, library):
    rnd = random.Random(2)
    for _ in range(5000):
        ids = [rnd.randrange(32_000) if rnd.random() < 0.4 else rnd.randrange(262) for _ in range(rnd.randrange(12))]
        assert words.decode(np.array(ids, "<u4")) == library.decode(ids), ids


def test_short_and_long_agendas_agree(words):
    for unit in strange(3, 500, 48):
        assert words.merged([unit])[1].tolist() == (words.merged_long(unit).tolist() if unit else [])


def test_cache_and_check(words, library, monkeypatch):
    monkeypatch.setattr(C, "CACHE_CHARS", 60)
    texts = strange(4, 200)
    for k in range(0, 200, 20):
        assert [C.ids_of(p) for p in words.encode(texts[k : k + 20])] == library.encode(texts[k : k + 20])
    monkeypatch.setattr(C.Vocabulary, "encode_units", lambda self, units: [b"\x05\0\0\0" for _ in units])
    words.known.clear()
    with pytest.raises(ValueError, match="other ids"):
        words.encode(["something else"], library=library)


def test_other_kinds_of_models_are_refused():
    with pytest.raises(ValueError, match="merge-type"):
        C.Vocabulary(b"\x12\x02\x18\x01")


def test_coded_rows(spark, library):
    texts = [None, "", " ", "a", "a", "</s>[INST] x", "word " * 50_000, *strange(5, 60)]
    rows = [(None if k == 3 else min(k, 4), t, "x", "y", "z", "i", "t") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(((r.doc_id, C.ids_of(r.ids), r.decoded, r.n_tokens) for r in C.coded(df, MODEL).collect()), key=str)
    want = [library.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    assert got == sorted(((r[0], w, library.decode(w), len(w)) for r, w in zip(rows, want, strict=True)), key=str)
    assert C.coded(df.limit(0), MODEL).count() == 0
    assert {r.n_tokens for r in C.coded(df.where("text = ''"), MODEL, begin=False, end=False).collect()} == {0}


# ---------------------------------------------------------------- alignment


FILE = public_tokenizers.path("byte_bpe_50k.json")


def plain(texts):
    """Loops over each text's tokens and bytes, the libraries called on whole texts."""
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(FILE), SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    of, names = A.byte_of_char(), {k: p for p, k in a.get_vocab().items()}
    left = lambda k: names[k].encode() if k == 50256 else bytes(of[c] for c in names[k])
    right = lambda k: bytes([int(b.id_to_piece(k)[3:-1], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode()
    docs, counts = [], Counter()
    for t in texts:
        x, y = a.encode(f" {t or ''}", add_special_tokens=False).ids, b.encode(t or "")
        xs, ys = [left(k) for k in x], [right(k) for k in y]
        if not t or not b"".join(xs) == b"".join(ys) == f" {t}".encode():
            docs.append((0, 0, [], []))
            continue
        ends = [list(accumulate(map(len, z))) for z in (xs, ys)]
        groups, start = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append(tuple([k for k, e in zip(ids, own, strict=True) if start < e <= cut] for ids, own in zip((x, y), ends, strict=True)))
            start = cut
        links = [(p, q) for g, h in groups for p in g for q in h]
        counts.update(set(links))
        docs.append((len(x), len(y), groups, links))
    highest = Counter()
    for (p, _), n in counts.items():
        highest[p] = max(highest[p], n)
    out = []
    for n_a, n_b, groups, links in docs:
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((n_a, n_b, len(groups), len(links), sum(counts[x] == highest[x[0]] for x in links), sum(counts[x] for x in links), text))
    return out


@pytest.mark.parametrize(("most", "digest"), [(10**6, False), (0, True)])
def test_alignment_equals_plain_loops(spark, monkeypatch, most, digest):
    monkeypatch.setattr(A, "BATCH_CHARS", 300)
    monkeypatch.setattr(A, "CACHE_CHARS", 200)
    more = ["don't  stop \n now", "<|endoftext|> <s>", "a ", " ", "  ", "\n", "naïve café\x1c !\x1c x", "x  y", "1234567 times " * 200, "word", "word", "▁▁"]
    texts = [None, "", *more, *strange(7, 150, 80)]
    rows = [(None if k == 5 else min(k, 9), t, "x", "y", "z", "i", "t") for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = A.linked(df, FILE, MODEL, digest=digest, most=most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    want = [(r[0], *x[:6], hashlib.sha256(x[6].encode()).hexdigest() if digest and x[6] else x[6]) for r, x in zip(rows, plain(texts), strict=True)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert A.linked(df.limit(0), FILE, MODEL, most=most).count() == 0


def test_units_give_the_ids_of_whole_texts(library):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(FILE)
    whole.encode_special_tokens = True
    with open(FILE) as f, open(MODEL, "rb") as g:
        a, b = A.ByteLevel(f.read()), A.Pieces(g.read())
    spaces = ["".join(random.Random(k).choice("  \n\t\r  \x1cab!'s1") for _ in range(30)) for k in range(2000)]
    texts = [*strange(8, 2000), *spaces]
    assert [C.ids_of(x) for x in a.encode(texts)] == [e.ids if t else [] for t, e in zip(texts, whole.encode_batch([f" {t}" for t in texts], add_special_tokens=False), strict=True)]
    assert [C.ids_of(x) for x in b.encode(texts)] == library.encode(texts)
