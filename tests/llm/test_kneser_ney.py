import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parcelscope.llm.kneser_ney import ORDER, _windows, gram_counts, identify, learn, op8_language_id, prune
from tests.llm.common import docs, rows


def test_held_out_accuracy(spark, smoke_dir):
    got = {r.doc_id: r for r in op8_language_id(spark, smoke_dir).collect()}
    given = rows(smoke_dir, "documents", "doc_id", "lang")
    assert len(got) == len(given)
    held = [(got[i].lang_pred, lang) for i, lang in given if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _ in given)
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def brute_cost(words, lang_words, alphabet):
    """Textbook interpolated Kneser-Ney of one language's words."""
    pad = " " * (ORDER - 1)
    grams = {ORDER: Counter()}
    for w in lang_words:
        s = pad + w + " "
        grams[ORDER].update(s[i:i + ORDER] for i in range(len(s) - ORDER + 1))
    for k in range(ORDER - 1, 0, -1):
        grams[k] = Counter(g[1:] for g in grams[k + 1])
    discount, total, kinds = {}, {}, {}
    for k, table in grams.items():
        n1, n2 = (sum(n == x for n in table.values()) for x in (1, 2))
        discount[k] = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total[k], kinds[k] = defaultdict(int), defaultdict(int)
        for g, n in table.items():
            total[k][g[:-1]] += n
            kinds[k][g[:-1]] += 1

    def p(g):
        out = 1 / (1 + alphabet)
        for k in range(1, ORDER + 1):
            x = g[-k:]
            if total[k][x[:-1]]:
                out = (max(grams[k][x] - discount[k], 0) + discount[k] * kinds[k][x[:-1]] * out) / total[k][x[:-1]]
        return out
    costs, n = 0.0, 0
    for w in words:
        s = pad + w + " "
        for i in range(len(s) - ORDER + 1):
            costs -= math.log(p(s[i:i + ORDER]))
            n += 1
    return costs / n


def test_model_equals_textbook(spark):
    texts = {"en": "the cat and the hat sat on that mat", "de": "der hund und die katze sind müde und satt",
             "x": "ababab abab ba"}
    model = learn(docs(spark, [(i, t, lang) for i, (lang, t) in enumerate(texts.items())]))
    alphabet = len(set("".join(texts.values())) | {" "})
    probe = ["that", "hund", "zebra", "ab"]
    ce, chars = model.entropies(pa.array([" ".join(probe)]))
    assert model.langs == ["de", "en", "x"] and chars[0] == sum(len(w) + 1 for w in probe)
    for j, lang in enumerate(model.langs):
        assert np.isclose(ce[0, j], brute_cost(probe, texts[lang].split(), alphabet))


def test_counts_cover_all_rows(spark):
    given = [(i, "aa ab" if i % 2 else "ab", "l") for i in range(40)]
    got = {r.gram: r.n for r in gram_counts(docs(spark, given).repartition(7), "lang", "text").collect()}
    assert got["   a"] == 60 and got["  ab"] == 40 and got["  aa"] == 20
    assert prune(spark.createDataFrame([("l", "aaaa", 5), ("l", "bbbb", 1)], "lang string, gram string, n bigint"),
                 1).collect()[0].gram == "aaaa"
    assert len(_windows(["ab"])[0]) == 3


def test_edge_cases(spark):
    long = "the quick brown fox and the lazy dog " * 5000
    given = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "", "de"),
             (5, "123 !!", "en"), (6, long, None), (6, long, None), (None, "das ist der hund", "de"), (7, "ö", "de")]
    got = [(r.row_id, r.best, r.score) for r in
           identify(docs(spark, given, clash=True), learn_from=F.col("doc_id").isNotNull()).collect()]
    assert len(got) == len(given)
    best = {i: (b, s) for i, b, s in got}
    assert best[3] == best[4] == best[5] == ("und", 0.0)
    assert best[6][0] == "en" and best[None][0] == "de" and best[1][0] == "en"
    nothing = identify(docs(spark, given), learn_from=F.lit(False)).collect()
    assert {r.best for r in nothing} == {"und"}
    assert identify(docs(spark, []), learn_from=F.lit(True)).count() == 0


def test_no_n_gram_is_left_out(spark):
    """Many parts give what one broadcast gives, also beside a hot language."""
    rng = random.Random(3)
    letters = {"en": "etaoinshrdlu", "de": "enisratdhulcgöü", "zh": "的一是不了人我在有他這中", "small": "wxyzq"}
    given = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(rng.randint(1, 6))) for _ in range(12)), lang)
             for i in range(120) for lang in [("en", "en", "en", "en", "de", "zh")[i % 6]]]
    given += [(200, "wxyz zyxw xyq", "small"), (201, "wxyz", None), (202, None, "en"), (203, "", "de"),
              (204, "12", "en"), (5, given[0][1], "en"), (5, given[0][1], "en"), (None, "wxyz", "small")]
    frame = docs(spark, given, clash=True).repartition(3)
    def found(**kw):
        got = identify(frame, learn_from=F.col("doc_id").isNotNull(), **kw).collect()
        return sorted((str(r.row_id), r.best, round(r.score, 9), r.rejected) for r in got), [r.ce for r in got]
    (whole, ce), (parts, split) = found(), found(max_grams=200)
    assert whole == parts and np.allclose(sorted(ce), sorted(split))
    assert ("201", "small") in {x[:2] for x in parts}
