import hashlib
import random

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from parcelscope.llm.piece_lattice import (
    MASK_CHARS, META, RUN_WORDS, _runs, _with_runs, decode, encode, encode_fragments, load, op9_piece_lattice)
from tests.llm.common import docs, rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The same pieces as a unigram model, with scores that stay exact."""
    model = proto.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    rng = random.Random(5)
    for p in model.pieces:
        if p.type == p.NORMAL:
            p.score = -6.0 - rng.randint(0, 64) / 8
    path = tmp_path_factory.mktemp("unigram") / "unigram.model"
    path.write_bytes(model.SerializeToString())
    return str(path)


def texts():
    rng = random.Random(9)
    bits = [" ", "  ", "\n", "\t", "a", "the", "ing", "日本", "é", "€", "😀", "\x01", "{", "e", "n", "an", "</s>", "<0x0A>",
            "==", "----", "0", "aaaa", "Anal", "gem", "▁", "tion"]
    out = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    pieces = list(load(MODEL).normal)
    out += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))).replace("▁", rng.choice(["", " "]))
            for _ in range(400)]
    return out + ["a" * 300, " " * 100, "ab" * (MASK_CHARS // 2), "ab" * MASK_CHARS, "\n" * 30, "abcdefghij" * 60]


def test_query_equals_library_and_round_trips(spark, smoke_dir):
    found = op9_piece_lattice(spark, smoke_dir)
    given = dict(rows(smoke_dir, "documents", "doc_id", "text"))
    got = {r.doc_id: r for r in found.collect()}
    assert {i: r.ids for i, r in got.items()} == {i: LIBRARY.encode(t or "") for i, t in given.items()}
    assert all(r.n_pieces == len(r.ids) for r in got.values())
    back = decode(found.withColumnRenamed("doc_id", "row_id"), MODEL)
    assert {r.row_id: r.text for r in back.collect()} == {i: t or "" for i, t in given.items()}


def test_merge_fold_equals_library(spark):
    given = list(enumerate(texts()))
    got = {r.row_id: r.ids for r in encode(docs(spark, given), MODEL).collect()}
    assert [(t, got[i], LIBRARY.encode(t)) for i, t in given if got[i] != LIBRARY.encode(t)] == []


def test_viterbi_fold_equals_library(spark, unigram):
    library = sentencepiece.SentencePieceProcessor(model_file=unigram)
    given = list(enumerate(texts()))
    got = {r.row_id: r.ids for r in encode(docs(spark, given), unigram).collect()}
    assert [(t, got[i], library.encode(t)) for i, t in given if got[i] != library.encode(t)] == []


def test_edge_cases(spark):
    long = "A long text, with words.\n" * 15_000
    given = [(1, None), (2, ""), (3, long), (3, long), (None, "x"), (4, " "), (5, "\n")]
    got = sorted([(str(r.row_id), r.ids) for r in encode(docs(spark, given, clash=True), MODEL).collect()])
    assert got == sorted([(str(i), LIBRARY.encode(t or "")) for i, t in given])
    assert encode(docs(spark, []), MODEL).count() == 0


def test_substrings_are_compiled_with_the_join(spark):
    """Starts and lengths are exploded, not an array of all substrings."""
    found = encode_fragments(spark.createDataFrame([("thing",), ("x",)], "fragment string"), load(MODEL))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate explode(sequence(") == 2 and "flatten(" not in plan


def test_words_and_ids_by_column():
    words, lengths = _with_runs(pa.array(["", "", "a", "", "\n", "", "b", "", ""]), np.array([0, 3, 2, 0, 4]))
    assert words.to_pylist() == [META * 2 + "a", "", "\n", META + "b", META] and lengths.tolist() == [0, 1, 2, 0, 2]
    own = load(MODEL)
    names, ids, size = own.ids(pa.array([own.mark, f"th{own.mark}ing", f"a{own.mark}\u0378"]))
    assert names == [own.mark, "thing", "a\u0378"] and size.tolist() == [1, 2, 3]
    assert ids.tolist() == [own.bytes[ord(own.mark)], *(own.normal[p][0] for p in ("th", "ing", "a")),
                            *(own.bytes[b] for b in "\u0378".encode())]
    ends = np.array([0, 5, 5, RUN_WORDS, RUN_WORDS + 1, 4 * RUN_WORDS, 4 * RUN_WORDS])
    assert list(_runs(ends)) == [(0, 3), (3, 4), (4, 5), (5, 6)] and list(_runs(np.array([0]))) == []


def _decoded(text):
    return len(text), hashlib.sha256(text.encode()).hexdigest()


def test_registered_queries_decode(spark, smoke_dir):
    given = {i: t or "" for i, t in rows(smoke_dir, "documents", "doc_id", "text")}
    got = op9_piece_lattice(spark, smoke_dir).collect()
    assert {r.doc_id: (r.n_decoded, r.decoded_sha256) for r in got} == {i: _decoded(t) for i, t in given.items()}
    few = docs(spark, [(1, None), (2, ""), (3, "a▁b  日本😀"), (3, "a▁b  日本😀"), (None, "x\n")])
    got = corpus_pipeline.pieces(spark, few, smoke_dir).collect()
    assert sorted((str(r.doc_id), r.n_decoded, r.decoded_sha256) for r in got) == sorted(
        (str(i), *_decoded(t)) for i, t in [(1, ""), (2, ""), (3, "a b  日本😀"), (3, "a b  日本😀"), (None, "x\n")])
