import inspect
import re

import corpus_pipeline
import sentencepiece
import public_tokenizers
from parcelscope.llm.queries import QUERIES
from parcelscope.llm.secret_forest import MASK
from pyspark.sql import functions as F

from parcelscope.llm.common import stored
from tests.llm import common
from tests.llm.common import rows
from tests.llm.test_decontaminate import brute
from tests.llm.test_simhash import brute_components, brute_fingerprint


def test_stages_equal_brute_force(spark, smoke_dir):
    given = spark.read.parquet(f"{smoke_dir}/documents.parquet")
    texts = dict(rows(smoke_dir, "documents", "doc_id", "text"))
    docs = given
    quality, near, bench, secret = (s for _, s in corpus_pipeline.STAGES[:4])
    docs = quality(spark, docs, smoke_dir).cache()
    left = {r.doc_id for r in docs.collect()}
    labels = dict(rows(smoke_dir, "labels", "doc_id", "quality"))
    assert all((i in left) == bool(q) for i, q in labels.items()) and docs.columns == given.columns
    docs = near(spark, docs, smoke_dir).cache()
    groups = brute_components({i: brute_fingerprint(texts[i], 3) for i in left}, 2)
    left = {i for i in left if groups[i] == i}
    assert {r.doc_id for r in docs.collect()} == left and docs.columns == given.columns
    docs = bench(spark, docs, smoke_dir).cache()
    hit = brute([(i, texts[i]) for i in left], rows(smoke_dir, "benchmark", "item_id", "text"))
    left = {i for i in left if not hit[i]}
    assert {r.doc_id for r in docs.collect()} == left and docs.columns == given.columns
    docs = secret(spark, docs, smoke_dir).cache()
    clean = {i: re.sub(r'(?<=token = ")[0-9a-f]{40}(?=")', MASK, texts[i]) for i in left}
    assert {r.doc_id: r.text for r in docs.collect()} == clean
    assert all(r.n_chars == len(clean[r.doc_id]) for r in docs.collect()) and docs.schema == given.schema
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.VOCABULARY))
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, smoke_dir).collect()}
    assert got == {i: library.encode(t) for i, t in clean.items()}


def test_stages_take_an_empty_table(spark, smoke_dir):
    docs = spark.read.parquet(f"{smoke_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, smoke_dir).count() == 0


def test_stages_in_a_chain_take_awkward_rows(spark, smoke_dir):
    """Nulls in every column, empty, long and repeated texts, clashing names."""
    plain = "The quick brown fox looked at the old house by the river and walked on. "
    given = [(1, plain * 3), (1, plain * 3), (2, None), (3, ""), (None, plain + "Nobody knows this one."),
             (4, plain * 60_000, None, None), (5, 'config token = "0123456789abcdef0123456789abcdef01234567" ' + plain, None, "s"),
             (6, "Ünïcode   text\nwith  lines\n" + plain, "de", None), (6, plain + "Another text of the same id.")]
    docs = common.docs(spark, given, clash=True).withColumn("n_chars", F.when(F.col("doc_id") != 6, F.col("n_chars")))
    columns, kept = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, smoke_dir), name)
        assert docs.columns == columns, name
        now = sorted(str((r.doc_id, r.n_chars)) for r in docs.select("doc_id", "n_chars").collect())
        assert kept is None or len(now) <= len(kept), name
        kept = now
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    assert len([i for i, _ in texts if i == 1]) <= 1 and not any("0123456789abcdef" in (t or "") for _, t in texts)
    assert all(r.gone_id == "u" and r.site_rate == 0.5 for r in docs.select("gone_id", "site_rate").collect())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.VOCABULARY))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, smoke_dir).collect()
    assert sorted((str(r.doc_id), r.ids) for r in last) == sorted((str(i), library.encode(t or "")) for i, t in texts)


def test_rows_per_distinct_text_are_never_broadcast(spark, monkeypatch):
    """Packed, the files of distinct runs and fragments are far smaller than
    what a broadcast of them holds."""
    from parcelscope.llm import piece_lattice, secret_forest
    ran = {}

    def kept(df, name):
        ran[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name)

    monkeypatch.setattr(secret_forest, "stored", kept)
    given = common.docs(spark, [(i, f"the token = {i:040x} was here") for i in range(40)])
    assert secret_forest.scan(given).count() == 40
    assert "Broadcast" not in ran["measured_candidates"] and "SortMergeJoin" in ran["measured_candidates"]
    coded = piece_lattice.encode(given, public_tokenizers.path(corpus_pipeline.VOCABULARY))
    assert coded.count() == 40
    ran = coded._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in ran and "SortMergeJoin" in ran


def test_registered():
    import __spark_entry__ as entry
    assert {re.match(r"op(\d+)_", name)[1] for name in QUERIES} == {str(i) for i in range(1, 14)}
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_native_operators_run_no_python():
    from parcelscope.llm import decontaminate, secret_forest
    for module in (decontaminate, secret_forest):
        assert not re.search(r"mapIn|applyIn|_udf|\budf\(|\.rdd\b|import (pandas|pyarrow|numpy)", inspect.getsource(module))
