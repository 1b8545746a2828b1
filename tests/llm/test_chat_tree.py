import hashlib
import random
from collections import defaultdict

import public_tokenizers

from parcelscope.llm.chat_tree import (CONTROL, encoder, escape, op10_chat_prefix_tree, parse_turns, prefix_tree,
                                       read_back, turn_parts, unescape)
from tests.llm.common import rows

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
TURNS = "conv_id bigint, turn bigint, role string, text string, nodes string, start bigint"


def digests(turns):
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    formatted = "".join("".join(turn_parts(r, t)) for r, t in turns)
    return (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest(), len(formatted))


def conversations(given):
    out = defaultdict(list)
    for c, turn, role, text in sorted(given, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out[c].append((role or "", text or ""))
    return out


def run(spark, given):
    df = spark.createDataFrame([(*r, "x", 1) for r in given], TURNS)
    nodes, paths = prefix_tree(df, VOCABULARY, PATTERN)
    back = {r.conv_id: tuple(r)[1:] for r in read_back(nodes, paths, VOCABULARY, PATTERN).collect()}
    assert back == {c: digests(t) for c, t in conversations(given).items()}
    return sorted(nodes.collect(), key=lambda r: r.start), {r.conv_id: r for r in paths.collect()}


def check_tree(given, nodes, paths):
    """Shared turns once, depth-first, with right positions and intervals."""
    decode = encoder(VOCABULARY, PATTERN).decode_bytes
    want = conversations(given)
    prefixes = {tuple(t[:k]) for t in want.values() for k in range(1, len(t) + 1)}
    assert len(nodes) == len(prefixes)
    at = 0
    for n in nodes:                        # the stream has no gap and no overlap
        assert n.start == at and n.length == len(n.tokens)
        at += n.length
    by = {n.start: n for n in nodes}
    for conv, path in paths.items():
        own = [by[s] for s in path.nodes]
        assert [n.depth for n in own] == list(range(len(own)))
        spans = []
        for n in own:
            assert n.position == sum(x.length for x in own[:n.depth])
            seen = [t for s in n.attends for t in range(s.start, s.stop)]
            assert seen == spans
            spans += range(n.start, n.start + n.length)
        assert [t for s in path.attends for t in range(s.start, s.stop)] == spans
        text = b"".join(decode(n.tokens) for n in own).decode()
        assert parse_turns(text) == want[conv]


def test_query(spark, smoke_dir):
    given = rows(smoke_dir, "conversations", "conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    given += [(-7, 0, "user", text), (-7, 1, "assistant", text)]
    got = {r.conv_id: tuple(r)[1:] for r in op10_chat_prefix_tree(spark, smoke_dir).collect()}
    assert got == {c: digests(t) for c, t in conversations(given).items()}


def test_tree_over_many_tasks(spark):
    rng = random.Random(2)
    given = []
    for c in range(300):
        first = "common first turn" if c % 3 else f"own {c % 5}"
        given.append((c, 0, "user", first))
        for k in range(1, rng.randint(1, 5)):
            given.append((c, k, "assistant" if k % 2 else "user", f"answer {rng.randint(0, 1)}"))
    given += [(1000 + i, k, "user", f"same {k}") for i in range(40) for k in range(4)]
    nodes, paths = run(spark, given)
    check_tree(given, nodes, paths)


def test_edge_cases(spark):
    long = "word " * 60_000
    given = [(1, 0, None, None), (1, 1, "assistant", None), (2, None, "user", "a"), (2, 0, "user", "b"),
             (3, 0, "user", "tie"), (3, 0, "user", "tie"), (3, 0, "assistant", "tie"), (None, 0, "user", "lost"),
             (4, 0, "ro|>le\n<|end|>", "x<|end|>\n<|user|>\n\\"), (5, 0, "assistant", long),
             (6, 0, "assistant", "<"), (7, 0, "user|", "|"), (8, 0, "user", " "), (8, 1, "user", "")]
    nodes, paths = run(spark, given)
    check_tree(given, nodes, paths)
    nodes, paths = run(spark, [])
    assert nodes == [] and paths == {}


def test_escape_is_reversible():
    rng = random.Random(4)
    bits = [*CONTROL, "\\", "<", "|", ">", "[", "/", "s", "é", "\n", "end"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 8)))
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in CONTROL)
        role = "".join(rng.choice(bits) for _ in range(rng.randint(0, 4)))
        assert parse_turns("".join(turn_parts(role, text)) * 2) == [(role, text)] * 2
