"""The pipeline: every stage on all that the one before kept; near dedup and decontamination against plain Python, toxicity against its own scores."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from factloom.llm import decontamination, exact_dedup, simhash, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    d = str(tmp_path_factory.mktemp("sf"))
    text = lambda n: " ".join(f"v{rnd.randrange(400)}" for _ in range(n))
    items = [(k, text(30)) for k in range(5)]
    texts = [text(rnd.randrange(30, 90)) for _ in range(200)]
    texts += texts[:30] + [t + "  " for t in texts[30:40]] + [f"{text(10)} {items[k % 5][1]} {text(40)}" for k in range(10)]
    texts += [" ".join([*t.split()[:-1], "tail"]) for t in texts[40:60]] + [None, "", "  "]
    rows = [(k, (t + " vile" if t and k % 6 == 0 and k < 200 else t), "en", rnd.choice(("s1", "s2", None)), 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder):
    docs, bench = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), before.schema)
        assert docs.columns == columns
        ids, kept = {r.doc_id for r in before.collect()}, {r.doc_id for r in docs.collect()}
        if name == "toxicity":
            out = toxicity.score(before, spark.read.parquet(f"{folder}/labels.parquet"), ~toxicity.held_out()).where("score < 0.5")
            assert kept == {r.doc_id for r in out.collect()} and not any("vile" in (r.text or "") for r in docs.collect())
        elif name == "exact_dedup":
            first = {}
            for r in sorted(before.collect()):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id)
            assert kept == set(first.values())
        elif name == "near_dedup":
            assert kept == {r.component_id for r in simhash.near_duplicates(before).collect()} and len(kept) < len(ids)
        else:
            hit = {r.doc_id for r in decontamination.contained(before, bench).collect()}
            assert kept == ids - hit and hit
    mixed = P.mixing(spark, docs, folder)
    assert {r.doc_id for r in mixed.collect()} == kept
    whole = P.run(spark, folder)
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, mixed.collect()), key=str)


def test_near_dedup_and_decontamination_against_plain_python(spark, folder):
    """The two stages' decisions from their definitions alone, and the folders that stay behind."""
    import xxhash

    docs, bench = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    docs = spark.createDataFrame(exact_dedup.keep_first_copies(docs).collect(), docs.schema)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}

    def fingerprint(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    prints, root = {i: fingerprint(t) for i, t in rows.items()}, {i: i for i in rows}
    changed = True
    while changed:  # the smallest id that links reach
        changed = False
        for a in rows:
            for b in rows:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and root[b] < root[a]:
                    root[a], changed = root[b], True
    near = P.near_dedup(spark, docs, folder)
    assert {r.doc_id for r in near.collect()} == set(root.values())

    def grams(text, n):
        w = re.findall(r"\w+", text.lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    items = [grams(r.text, 5) for r in bench.collect()]
    hit = {i for i, t in rows.items() if any(len(g & grams(t, 5)) >= 0.8 * len(g) for g in items)}
    assert hit and {r.doc_id for r in P.decontamination(spark, docs, folder).collect()} == set(rows) - hit


def test_stages_without_labels_or_items_and_with_null_ids(spark, folder, tmp_path):
    """No labels: nothing is toxic; no items: nothing is dropped; rows with null ids go through all stages."""
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(20)
    docs = spark.createDataFrame([*docs.collect(), (None, "a text without an id " * 3, None, None, None)], docs.schema)
    assert P.toxicity(spark, docs, str(tmp_path)).count() == 21 and P.decontamination(spark, docs, str(tmp_path)).count() == 21
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = P.run(spark, str(tmp_path)).collect()
    assert sum(r.doc_id is None for r in out) == 1
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet").withColumns({"_text": F.lit("t"), "score": F.lit(0), "spans": F.lit("s"), "size": F.lit(1), "members": F.lit("m"), "_bucket": F.lit(2), "item_id": F.lit(3)})
    for stage in (P.toxicity, P.decontamination):
        assert stage(spark, kept, str(tmp_path)).columns == kept.columns
    assert P.mixing(spark, kept, str(tmp_path)).count() == 21


def test_stages_take_empty_documents(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_exact_stage_keeps_columns_that_clash(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"_key": F.lit("k"), "_norm": F.lit("n"), "_hash": F.lit("h"), "_row": F.lit("r")})
    for keep in (exact_dedup.keep_first_copies, simhash.keep_one_of_each):
        assert {tuple(r) for r in keep(docs).select("_key", "_norm", "_hash", "_row").collect()} == {("k", "n", "h", "r")}
