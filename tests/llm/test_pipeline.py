"""The pipeline's stages keep documents' columns and decide by row; run() gives what plain code gives."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from chronofact.llm import exact_dedup
from chronofact.llm.secrets import find_secrets, redact
from chronofact.llm.toxicity import scored, train
from tests.llm.test_similar_texts import brute_kept

ODD = "doc_id long, text string, lang string, source string, n_chars long, _old string, _score double, row long, doc string"


def odd_rows():
    rng = random.Random(9)
    long = " ".join(f"w{rng.randint(0, 99999)}" for _ in range(20000))
    base = [f"v{i}" for i in range(100)]
    near = [*base[:50], "changed", *base[51:]]
    texts = [
        (1, "x one"),
        (1, "only copy of this text"),
        (2, "x one"),
        (None, "dup"),
        (None, "dup"),
        (None, "dup"),
        (None, None),
        (3, None),
        (4, ""),
        (4, ""),
        (5, long),
        (6, long + " more"),
        (7, " ".join(base)),
        (8, " ".join(near)),
        (8, "another text of id eight"),
        (9, "the token=0123456789abcdef0123 is here"),
    ]
    return [(i, t, "en", "s", len(t or ""), "keep me", 0.5, 7, "mine") for i, t in texts]


def table(spark, rows):
    return spark.createDataFrame(rows, ODD).repartition(3)


def plain_copies(rows):
    """Of equal texts, the largest doc_id stays."""
    best = {}
    for i, t in rows:
        key = t or ""
        if key not in best or (best[key][0] is None and i is not None) or (i is not None and i > best[key][0]):
            best[key] = (i, t)
    return sorted(((i, k) for k, (i, _) in best.items()), key=str)


def plain_similar(rows):
    ids = [(n, t) for n, (_, t) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))]
    kept, _ = brute_kept(ids)
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    return sorted((order[n] for n in kept), key=str)


def pairs(df):
    return sorted(((r["doc_id"], r["text"] or "") for r in df.collect()), key=str)


def test_stages_on_odd_rows(spark, sf_dir):
    rows = odd_rows()
    docs = table(spark, rows)
    plain = [(r[0], r[1]) for r in rows]
    one = corpus_pipeline.reject_toxic(spark, docs, sf_dir)
    assert one.columns == docs.columns and pairs(one) == sorted(((i, t or "") for i, t in plain), key=str)
    two = corpus_pipeline.drop_copies(spark, docs, sf_dir)
    assert two.columns == docs.columns and pairs(two) == plain_copies(plain)
    three = corpus_pipeline.drop_similar(spark, two, sf_dir)
    assert three.columns == docs.columns and pairs(three) == plain_similar(plain_copies(plain))
    four = corpus_pipeline.mask_secrets(spark, three, sf_dir)
    assert four.columns == docs.columns and four.count() == three.count()
    got = {(r["doc_id"], r["text"]): r for r in four.collect()}
    assert got[9, "the [assign] is here"]["n_chars"] == 20
    assert {(r["_old"], r["_score"], r["row"], r["doc"]) for r in got.values()} == {("keep me", 0.5, 7, "mine")}
    packed = corpus_pipeline.pack_sequences(spark, four, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == {i for i, _ in got}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_run_gives_what_plain_code_gives(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    clean = [(r["doc_id"], r["text"]) for r in docs.where(scored(train(docs, labels)) < corpus_pipeline.TOXIC).collect()]
    assert 0.8 * docs.count() < len(clean) < docs.count()
    left = [(i, redact(t)) for i, t in plain_similar(plain_copies(clean))]
    assert not any(s[0] in ("access", "hex") for _, t in left for s in find_secrets(t))
    encoder = __import__("tokenizers").Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.encode_special_tokens = True
    want = {i: len(encoder.encode(t, add_special_tokens=False).ids) + 1 for i, t in left}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    total, ends = {}, {}
    for r in got:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert total == want and [n for n, _ in corpus_pipeline.STAGES][1:4] == ["exact_dedup", "simhash_near_dedup", "secret_scans"]
    for spans in ends.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048


def test_stages_hold_few_texts_at_once(spark):
    """Exact dedup looks at some megabytes of texts together, and stages send small batches to Python."""
    n, text = 3000, "x" * 4000
    ids = pa.array(range(n), pa.int64())
    batch = pa.RecordBatch.from_pydict({"doc_id": ids, "text": pa.array([f"{i} {text}" for i in range(n)]), "h": ids, "text_sha256": pa.array(map(str, range(n)))})
    parts = list(exact_dedup.fold(iter([batch, batch.slice(0, 0)]), np.array([0])))
    assert sum(p.num_rows for p in parts) == n and max(p["text"].nbytes for p in parts) <= 1.1 * exact_dedup.BYTES
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        for name, stage in corpus_pipeline.STAGES[1:]:
            stage(spark, table(spark, odd_rows()[:3]), "")
            assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000", name
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_chain_across_parts_keeps_its_row(spark, monkeypatch):
    """Kept rows come from several parts and batches where a hash value's chain goes on."""
    monkeypatch.setattr(exact_dedup, "BYTES", 10)
    entries = [(0, 1, "a", "one one one", 5, 1), (0, 1, "a", "one one one", 9, 2), (0, 1, "b", "two", 7, 1), (0, 2, "c", "", None, 1), (0, 3, "d", "three three", 2, 1)]
    names = ["bucket", "h", "text_sha256", "text", "keep_id", "n", "doc"]
    types = [pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    rows = [(*e, f"row {e[4]}") for e in entries]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    got = pa.Table.from_batches(exact_dedup.own(iter([batch.slice(0, 2), batch.slice(2)])))
    assert got.select(["keep_id", "text", "group_size", "doc"]).to_pylist() == [
        {"keep_id": k, "text": t, "group_size": n, "doc": f"row {k}"} for k, t, n in ((9, "one one one", 3), (7, "two", 1), (None, "", 1), (2, "three three", 1))
    ]
