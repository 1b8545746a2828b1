import random

import public_tokenizers
import pyarrow as pa
import sentencepiece

from parcelscope.llm.bpe_counts import count_tokens, load, op2_token_counts, token_counts
from tests.llm.common import docs, rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_query_equals_library(spark, smoke_dir):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in op2_token_counts(spark, smoke_dir).collect()}
    for i, text in rows(smoke_dir, "documents", "doc_id", "text"):
        n = len(LIBRARY.encode(text or ""))
        assert got[i] == (len((text or "").encode()), n, n > 4096)


def test_strings_equal_library():
    rng = random.Random(7)
    bits = ["▁", " ", "  ", "\n", "\t", "a", "the", "ing", "日本", "é", "€", "😀", "\x01", "\x00", "{", "}", "e", "n", "an",
            "</s>", "<0x0A>", "<unk>", "==", "----", "0", "12", "aaaa", "Anal", "▁Eff", "gem"]
    pieces = list(load(MODEL).ids)
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 9))).replace("▁", rng.choice(["", " ", "▁"]))
              for _ in range(3000)]
    texts += ["a" * 400, " " * 200, "ab" * 300, "日本語" * 100, "=-" * 200, "\n" * 40, "</s>[INST] x"]
    got = token_counts(pa.array(texts), load(MODEL)).tolist()
    want = [len(x) for x in LIBRARY.encode(texts)]
    assert [(t, g, w) for t, g, w in zip(texts, got, want) if g != w] == []


def test_edge_cases(spark):
    long = "Some words, more words.\n" * 20_000
    given = [(1, None), (2, ""), (3, long), (3, long), (None, "x")]
    got = sorted([tuple(r) for r in count_tokens(docs(spark, given, clash=True), MODEL).collect()], key=str)
    n = len(LIBRARY.encode(long))
    assert got == sorted([(1, 0, 0), (2, 0, 0), (3, len(long), n), (3, len(long), n), (None, 1, 1)], key=str)
    assert count_tokens(docs(spark, []), MODEL).count() == 0
