import itertools

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_interpolation_decontam import leaks
from tests.llm.test_overlap import groups
from tests.llm.test_simhash_lines import SPACED, lines_without
from weftline.llm import pieces, toxicity


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The small tables with odd rows, copies and repeated passages added."""
    d, src = tmp_path_factory.mktemp("tables"), "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{src}/documents.parquet")
    first = docs.orderBy("doc_id").first().text
    extra = [(10_001, None), (10_002, ""), (10_003, first), (10_004, f"{first}\nand a new line at the end"), (10_005, " \n ")]
    more = spark.createDataFrame([(i, t, "en", "x", None) for i, t in extra], docs.schema)
    docs.unionByName(more).withColumn("_kept_id", F.lit(1)).write.parquet(f"{d}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{src}/{name}.parquet").write.parquet(f"{d}/{name}.parquet")
    return str(d)


def test_stages_against_brute_force(spark, folder):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"), ~toxicity.held_out(F.col("doc_id")))
    ids = sorted(rows)
    ids = [i for i, s in zip(ids, model.score([rows[i] for i in ids]), strict=True) if s < 0.5]
    texts, removed = lines_without([rows[i] for i in ids], ids)
    kept = [(i, t) for i, t, n in zip(ids, texts, removed, strict=True) if n == 0 or SPACED.search(t)]
    root = groups([t for _, t in kept])
    kept = [x for at, x in enumerate(kept) if root[at] == at]
    kept = [(i, t) for i, t in kept if not leaks(t, items)[1]]
    sampler = pieces.Sampler(pieces.load(corpus_pipeline.PIECE_MODEL))
    want = {i: None if t is None else x.tolist() for (i, t), x in zip(kept, sampler.encode([i for i, _ in kept], [t or "" for _, t in kept]), strict=True)}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == want and len(want) > 50


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    for (_, stage), empty in itertools.product(corpus_pipeline.STAGES[:-1], (False, True)):
        out = stage(spark, docs.where("false") if empty else docs, folder)
        assert out.columns == docs.columns and (out.count() == 0) == empty
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), folder).count() == 0
