import re
from collections import defaultdict

from parcelscope.llm.decontaminate import drop_contaminated, op3_template_decontamination, templates, verdicts, windows
from tests.llm.common import docs, rows

ITEM = ("A train leaves Paris at 9 and drives 120 km per hour towards Lyon while Anna counts 17 cows on the field. "
        "When does Anna reach Lyon if the way is 470 km long")
#: The same question with other numbers and names, each replaced alike.
CHANGED = (ITEM.replace("Paris", "Berlin").replace("Lyon", "Bremen").replace("Anna", "Oskar").replace("120", "85")
           .replace("470", "391").replace("17", "44"))
#: One name stands for two values.
MIXED = CHANGED.replace("Oskar reach Bremen", "Peter reach Dresden")


def benchmark(spark, given):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in given], "item_id bigint, text string, at int, canon string")


def run(spark, given, items):
    got = verdicts(docs(spark, given, clash=True), benchmark(spark, items)).collect()
    assert len(got) == len(given)
    return {r.row_id: r for r in got}


def brute(given, items):
    """Documents with at least 0.8 of an item's plain five-word windows."""
    def words(t):
        return re.findall(r"[^\W\d_]+|\d+", (t or "").lower())
    index, total = defaultdict(set), {}
    for i, t in items:
        w = words(t)
        own = {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
        total[i] = len(own)
        for x in own:
            index[x].add(i)
    out = {}
    for d, t in given:
        w, hit = words(t), defaultdict(set)
        for k in range(len(w) - 4):
            for i in index.get(tuple(w[k:k + 5]), ()):
                hit[i].add(tuple(w[k:k + 5]))
        out[d] = sorted(i for i, s in hit.items() if len(s) >= 0.8 * total[i])
    return out


def test_query_equals_brute_force(spark, smoke_dir):
    want = brute(rows(smoke_dir, "documents", "doc_id", "text"), rows(smoke_dir, "benchmark", "item_id", "text"))
    got = {r.doc_id: r for r in op3_template_decontamination(spark, smoke_dir).collect()}
    assert {i: r["items"] for i, r in got.items()} == want
    assert any(want.values()) and all(r.contaminated == bool(want[i]) for i, r in got.items())


def test_re_parameterised_questions(spark):
    around = "Some words come first, and then. {} And here the text goes on with more words."
    got = run(spark, [(1, around.format(ITEM)), (2, around.format(CHANGED)), (3, around.format(MIXED)),
                      (4, around.format(ITEM[:60])), (5, "nothing of the kind")], [(10, ITEM), (11, ITEM.lower() * 2)])
    assert got[1].contaminated and got[1].exact and 10 in got[1]["items"]
    assert got[2].contaminated and not got[2].exact and got[2].containment == 1.0
    assert not got[3].contaminated and not got[4].contaminated and not got[5].contaminated


def test_letter_case(spark):
    around = "Some words come first, and then. {} And here the text goes on with more words."
    german = "Die Schüler messen auf der Straße 12 Bäume und rechnen mit Anna die Höhe aller Bäume im Garten aus"
    other = CHANGED.upper().replace("OSKAR", "ANNA").replace("BERLIN", "PARIS").replace("BREMEN", "LYON")
    got = run(spark, [(1, around.format(ITEM.upper())), (2, around.format(ITEM.lower())), (3, ITEM.upper()),
                      (4, around.format(german.upper())), (5, german.lower()), (6, around.format(other)),
                      (7, around.format(MIXED.upper())), (8, around.format(ITEM.title())), (9, around.upper())],
              [(10, ITEM), (11, german)])
    assert {i: r["items"] for i, r in got.items()} == {1: [10], 2: [10], 3: [10], 4: [11], 5: [11], 6: [10], 7: [],
                                                       8: [10], 9: []}
    assert all(got[i].containment == 1.0 and got[i].exact for i in (1, 2, 3, 4, 5, 8)) and not got[6].exact
    # an item in capitals, a document in usual letters
    assert run(spark, [(1, around.format(ITEM))], [(10, ITEM.upper())])[1].exact


def test_tables_of_numbers_are_clean(spark):
    numbers = " ".join(str(i * 37 % 101) for i in range(60))
    other = " ".join(str(i * 53 % 97) for i in range(60))
    got = run(spark, [(1, other), (2, numbers)], [(1, numbers)])
    assert not got[1].contaminated and got[2].contaminated and got[2].exact


def test_templates(spark):
    df = spark.createDataFrame([(1, "It weighs 3.5 kg in Rome. Then Bob's dog, 2 days on!")], "i int, t string")
    row = templates(df, "t").first()
    assert [t.c for t in row.tokens] == ["it", "weighs", "<num>", "<unit>", "in", "<name>", "then", "<name>", "dog", "<num>", "<unit>", "on"]
    assert [t.r for t in row.tokens[2:4]] == ["3.5", "kg"]


def test_windows_hash_each_token_once(spark):
    """A window's hash is made of its tokens' hashes; no window is cut out."""
    given = [(1, "It weighs 3.5 kg in Rome. Then Bob goes"), (2, "just Four words here"), (3, "..."), (4, None)]
    made = windows(templates(spark.createDataFrame(given, "i int, t string"), "t")).select("i", "windows")
    got = [(r.i, w) for r in sorted(made.collect()) for w in r.windows or ()]
    assert [(i, w["values"]) for i, w in got] == [
        (1, "3.5\x1fkg"), (1, "3.5\x1fkg\x1f\x1eRome"), (1, "3.5\x1fkg\x1f\x1eRome"),
        (1, "kg\x1f\x1eRome\x1f\x1eBob"), (1, "\x1eRome\x1f\x1eBob"), (2, "\x1eFour")]
    assert len({w["hash"] for _, w in got}) == 6
    assert [w["hash"] == w["folded"] for _, w in got] == [True] + [False] * 5
    assert "slice(" not in made._jdf.queryExecution().executedPlan().toString()


def test_edge_cases(spark):
    long = "filler words go on and on. " * 8000 + ITEM
    given = [(1, None), (2, ""), (3, "two words"), (4, long), (4, long), (None, ITEM), (5, "..."), (6, ITEM + " " + ITEM)]
    items = [(10, ITEM), (10, ITEM), (11, None), (12, ""), (13, "two words"), (None, "x y z a b c d")]
    got = run(spark, given, items)
    assert [got[i]["items"] for i in (1, 2, 3, 4, 5, 6, None)] == [[], [], [13], [10], [], [10], [10]]
    clean = drop_contaminated(docs(spark, given, clash=True), benchmark(spark, items))
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2, 5] and len(clean.columns) == 15
    assert run(spark, given, [])[4].contaminated is False
    assert verdicts(docs(spark, []), benchmark(spark, items)).count() == 0
