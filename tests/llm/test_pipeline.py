import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm.quality import classify
from auditloom.llm.queries import tokenizer_path
from tests.llm.conftest import WORDS
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_near_dedup import LOWER, brute as near


def prose(seed, n):
    """Plain words of two parts, so that the classifier keeps it and texts share few shingles."""
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def edited(text, share, rng):
    return " ".join(w if rng.random() > share else rng.choice(WORDS) for w in text.split())


def brute(judged, rows, items, library):
    """All stages on plain rows; only the classifier's verdicts are taken from it."""
    rows = [r for r in rows if judged[r]]
    last = {}
    for i, t in rows:
        last.setdefault((t or "").translate(LOWER), []).append((i, t))
    rows = [max(group, key=lambda r: -(2**63) if r[0] is None else r[0]) for group in last.values()]
    smallest = {i: c for i, _, c in near(rows, 5)}
    rows = [r for r in rows if smallest[r[0]] == r[0]]
    bad = {r[0] for r in contaminated(rows, items, 13) if r[-1]}
    out = []
    for i, t in rows:
        if i not in bad:
            ids = library.encode(t or "", add_eos=True)
            out.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out, key=repr)


def written(spark, tmp_path, rows, items):
    df = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumn("kept", F.lit("x")).withColumn("_id", F.lit(1)).withColumn("node", F.lit(2))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_against_brute_force(spark, tmp_path):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(6)
    items = [(i, prose(5000 + i, 40)) for i in range(6)] + [(9, None)]
    rows = [(i, prose(i, 80)) for i in range(100)]
    rows += [(200 + i, rows[i][1].upper() if i % 7 == 0 else rows[i][1]) for i in range(0, 60, 3)]
    rows += [(300 + i, edited(rows[i % 30][1], rng.choice([0.02, 0.1]), rng)) for i in range(60)]
    rows += [(400 + i, f"{prose(7000 + i, 60)} {items[i % 6][1]} {prose(8000 + i, 20)}") for i in range(12)]
    rows += [(500 + i, "BUY NOW !!! $$$ | | " * 20) for i in range(15)] + [(600, None), (601, ""), (None, "a null id and some plain words of text")]
    sf_dir = written(spark, tmp_path, rows, items)
    judged = {(r.doc_id, r.text): r.kept for r in classify(spark.read.parquet(f"{sf_dir}/documents.parquet")).join(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumnRenamed("kept", "x").select(F.col("doc_id").alias("d"), "text"), F.col("doc_id").eqNullSafe(F.col("d"))).collect()}
    got = corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got), key=repr) == brute(judged, rows, items, library)
    ids = {r.doc_id for r in got}
    assert not ids & set(range(400, 412)) and not ids & set(range(500, 515)) and 601 in ids and None in ids


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    sf_dir = written(spark, tmp_path, [(i, prose(i, 30)) for i in range(20)], [(1, "a b c")])
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema == docs.schema


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, written(spark, tmp_path, [], [])).count() == 0


@pytest.mark.parametrize("same", [None, 7])
def test_rows_with_one_id_are_dropped_one_by_one(spark, tmp_path, same):
    items = [(i, prose(5000 + i, 40)) for i in range(3)]
    texts = [prose(i, 80) for i in range(30)]
    rows = [(same, t) for t in texts] + [(100 + i, prose(100 + i, 80)) for i in range(30)]
    docs = spark.read.parquet(f"{written(spark, tmp_path, rows + [(same, t.upper()) for t in texts[:10]] + [(same, t) for t in texts[5:15]], items)}/documents.parquet")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.exact(spark, docs, str(tmp_path)).collect()]
    assert sorted((i, t.lower()) for i, t in left if i != same) == sorted(r for r in rows if r[0] != same)
    assert sorted(t.lower() for i, t in left if i == same) == sorted(texts)

    close = [(same, t + " one") for t in texts[:10]] + [(50 + i, texts[i] + " two") for i in range(10, 20)]
    docs = spark.createDataFrame(rows + close, "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/close")
    docs = spark.read.parquet(f"{tmp_path}/close")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, str(tmp_path)).collect()]
    assert len(left) == 60 and len([r for r in left if r[0] == same]) == 30
    assert not [r for r in left if r in close[10:]]

    dirty = [(same, f"{prose(7000 + i, 60)} {items[i % 3][1]} {prose(8000 + i, 20)}") for i in range(12)]
    docs = spark.createDataFrame(rows + dirty, "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/dirty")
    docs = spark.read.parquet(f"{tmp_path}/dirty")
    left = [(r.doc_id, r.text) for r in corpus_pipeline.clean_of_benchmarks(spark, docs, str(tmp_path)).collect()]
    assert sorted(left, key=repr) == sorted(rows, key=repr)
