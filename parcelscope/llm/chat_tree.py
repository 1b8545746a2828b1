"""Chat formatting as a prefix tree.

A turn is written as ``<|role|>\\ntext<|end|>\\n``; control strings inside
roles and texts are escaped by a backslash, reversibly.  Conversations that
share initial turns share the nodes of a prefix tree, one node per turn.
Sorted by the hash chain of their turns, the conversations come in
depth-first order: each emits the nodes it does not share with its
predecessor, so shared tokens are emitted once.  A node carries its place
``start`` in the token stream, its ``position`` (position id of its first
token: the tokens of its ancestors), the merged token intervals of its
ancestors that it may attend to, its tokens and the token range under the
loss mask (the text of an assistant turn).

The sort is by range over all tasks, also for one first turn shared by a
third of the conversations and for equal conversations (ties go by id).
Every task lays out its own range; the only thing that crosses the driver is
one summary per task (the paths at the two ends of its range and its number
of tokens), from which the offset of each task and the nodes it shares with
the tasks before it follow.

One conversation is the unit that a task holds: its formatted text and its
digest are one sequence.

Edge cases.  Turns are ordered by turn, then role, then text; nulls come
first and repeated rows are turns of their own.  A null role or text is
empty.  Rows with a null conversation id are one conversation.  An empty
table gives no nodes and no paths; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelscope.llm.common import stored, table

OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"
# Control strings of this and of common chat templates.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
# a backslash, or the first character of a control string (they may overlap)
_ESCAPE = re.compile("|".join([r"\\", *(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL)]))
_UNESCAPE = re.compile(r"\\(.)", re.S)

LAID = ("kind string, task int, conv_id bigint, fresh int, from_first int, starts array<bigint>, "
        "lengths array<bigint>, hashes array<binary>, tokens array<array<int>>, loss array<array<int>>")
LAID_FIELDS = [f.split(" ")[0] for f in LAID.split(", ")]
NODES = ("start bigint, length bigint, depth int, position bigint, "
         "attends array<struct<start: bigint, stop: bigint>>, tokens array<int>, loss_from int, loss_to int")
PATHS = "conv_id bigint, nodes array<bigint>, attends array<struct<start: bigint, stop: bigint>>"
READ = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def turn_parts(role: str, text: str) -> tuple[str, str, str]:
    """Head, body and tail of a formatted turn."""
    return OPEN + escape(role) + SHUT, escape(text), END


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of a formatted conversation; raises if it is none."""
    out, at = [], 0
    while at < len(formatted):
        shut = formatted.find(SHUT, at + len(OPEN))
        end = formatted.find(END, shut + len(SHUT))
        if not formatted.startswith(OPEN, at) or shut < 0 or end < 0:
            raise ValueError(f"no turn at character {at}")
        out.append((unescape(formatted[at + len(OPEN):shut]), unescape(formatted[shut + len(SHUT):end])))
        at = end + len(END)
    return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str):
    """Byte-level BPE from a rank file; lossless, without special tokens."""
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _chains(turns: list[dict]) -> list[bytes]:
    """Hash of each prefix of the conversation."""
    out, last = [], b""
    for t in turns:
        h = hashlib.blake2b(last, digest_size=16)
        for part in (t["role"], t["text"]):
            raw = part.encode("utf-8", "surrogatepass")
            h.update(len(raw).to_bytes(8, "little") + raw)
        last = h.digest()
        out.append(last)
    return out


def _shared(a: list, b: list) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _lay_out(sorted_convs: DataFrame, path: str, pattern: str, loss_role: str) -> DataFrame:
    """Each task's own depth-first layout, offsets from the task's start."""
    types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()),
             pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.list_(pa.int32())),
             pa.list_(pa.list_(pa.int32()))]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], t)
                                           for f, t in zip(LAID_FIELDS, types)], LAID_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encode = encoder(path, pattern).encode_ordinary
        hashes, starts, lengths, first, total, from_first = [], [], [], None, 0, 0
        for whole in batches:
            out, size = [], 0
            for row in range(whole.num_rows):
                conv, turns = whole.column(0)[row].as_py(), whole.column(1)[row].as_py()
                chain = _chains(turns)
                fresh = _shared(hashes, chain)
                from_first = min(from_first, fresh) if first is not None else len(chain)
                starts, lengths, hashes = starts[:fresh], lengths[:fresh], chain
                tokens, loss = [], []
                for t in turns[fresh:]:
                    head, body, tail = (encode(p) for p in turn_parts(t["role"], t["text"]))
                    tokens.append(head + body + tail)
                    loss.append([len(head), len(head) + len(body)] if t["role"] == loss_role else [0, 0])
                    starts.append(total)
                    lengths.append(len(tokens[-1]))
                    total += lengths[-1]
                if first is None:
                    first = (chain, lengths[:])
                out.append({"kind": "conv", "task": task, "conv_id": conv, "fresh": fresh,
                            "from_first": from_first, "starts": starts[:], "lengths": lengths[:],
                            "tokens": tokens, "loss": loss})
                size += sum(map(len, tokens)) + 4 * len(starts)
                if size > 1 << 18:
                    yield batch(out)
                    out, size = [], 0
            yield batch(out)
        if first is not None:
            yield batch([{"kind": "first", "task": task, "lengths": first[1], "hashes": first[0]},
                         {"kind": "last", "task": task, "fresh": total, "from_first": from_first,
                          "starts": starts, "lengths": lengths, "hashes": hashes}])

    return sorted_convs.mapInArrow(run, LAID)


def _offsets(ends: list) -> dict[int, tuple[int, list[int]]]:
    """Per task: what to add to its own offsets, and the places of the nodes
    at the head of its first path that earlier tasks have emitted."""
    tasks: dict[int, dict] = {}
    for r in ends:
        tasks.setdefault(r.task, {})[r.kind] = r
    out, base, path, places = {}, 0, [], []
    for task in sorted(tasks):
        first, last = tasks[task]["first"], tasks[task]["last"]
        common = _shared(path, first.hashes)
        carried = places[:common]
        add = base - sum(first.lengths[:common])
        out[task] = (add, carried)
        keep = min(common, last.from_first)
        places = carried[:keep] + [s + add for s in last.starts[keep:]]
        path = last.hashes
        base = add + last.fresh
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        elif b > a:
            out.append((a, b))
    return out


def prefix_tree(turns: DataFrame, tokenizer: str, pattern: str, loss_role: str = "assistant",
                id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(nodes, paths)``: the token stream in depth-first order, one row per
    node, and per conversation the places of its nodes and the merged
    intervals of its tokens."""
    spark = turns.sparkSession
    rows = turns.select(F.col(id_col).cast("bigint").alias("conv_id"), F.struct(
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("t"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [b"".join(_chains(b.column(1)[i].as_py())) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.binary())],
                                             ["conv_id", "turns", "key"])

    keyed_convs = stored(convs.mapInArrow(
        keyed, "conv_id bigint, turns array<struct<turn: bigint, role: string, text: string>>, key binary"), "convs")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = (keyed_convs.repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
               .select("conv_id", "turns"))
    laid = stored(_lay_out(ordered, tokenizer, pattern, loss_role), "layout")
    # two rows per task of the range partitioning
    offsets = _offsets(laid.where("kind <> 'conv'").collect())

    def placed(starts, lengths, from_first, task):
        add, carried = offsets[task]
        keep = min(from_first, len(carried))
        at = carried[:keep] + [s + add for s in starts[keep:]]
        return keep, at, [(a, a + n) for a, n in zip(at, lengths)]

    def span(merged):
        return [{"start": a, "stop": b} for a, b in merged]

    spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def node_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[] for _ in range(8)]
            for task, fresh, from_first, starts, lengths, tokens, loss in zip(*(c.to_pylist() for c in b.columns)):
                keep, at, own = placed(starts, lengths, from_first, task)
                merged, position = _merged(own[:fresh]), sum(lengths[:fresh])
                for d in range(fresh, len(at)):
                    if d >= keep:       # else an earlier task has emitted it
                        for c, v in zip(cols, (at[d], lengths[d], d, position, span(merged),
                                               tokens[d - fresh], *loss[d - fresh])):
                            c.append(v)
                    merged = _merged([*merged, own[d]])
                    position += lengths[d]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), spans, pa.list_(pa.int32()),
                     pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             ["start", "length", "depth", "position", "attends", "tokens",
                                              "loss_from", "loss_to"])

    def path_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            conv, at, own = [], [], []
            for task, c, from_first, starts, lengths in zip(*(x.to_pylist() for x in b.columns)):
                _, places, each = placed(starts, lengths, from_first, task)
                conv.append(c)
                at.append(places)
                own.append(span(_merged(each)))
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(at, pa.list_(pa.int64())),
                                              pa.array(own, spans)], ["conv_id", "nodes", "attends"])

    mine = laid.where("kind = 'conv'")
    nodes = stored(mine.select("task", "fresh", "from_first", "starts", "lengths", "tokens", "loss")
                   .mapInArrow(node_rows, NODES), "nodes")
    paths = stored(mine.select("task", "conv_id", "from_first", "starts", "lengths")
                   .mapInArrow(path_rows, PATHS), "paths")
    return nodes, paths


def read_back(nodes: DataFrame, paths: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """Per conversation, from the tokens alone: its number of turns, digests
    of the turns and of the text under the loss mask, and its lengths."""
    steps = paths.select("conv_id", F.posexplode("nodes").alias("depth", "start"))
    joined = (steps.join(nodes.select("start", "tokens", "loss_from", "loss_to"), "start")
              .groupBy("conv_id").agg(F.sort_array(F.collect_list(
                  F.struct("depth", "tokens", "loss_from", "loss_to"))).alias("steps")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(tokenizer, pattern).decode_bytes
        for b in batches:
            out = []
            for row in range(b.num_rows):
                own = b.column(1)[row].as_py()
                formatted = b"".join(decode(s["tokens"]) for s in own).decode("utf-8", "surrogatepass")
                turns = parse_turns(formatted)
                whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
                for role, text in turns:
                    whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for s in own:
                    masked = unescape(decode(s["tokens"][s["loss_from"]:s["loss_to"]]).decode("utf-8", "surrogatepass"))
                    loss.update(masked.encode("utf-8", "surrogatepass"))
                    chars += len(masked)
                out.append((b.column(0)[row].as_py(), len(turns), whole.hexdigest(), chars, loss.hexdigest(),
                            len(formatted)))
            names = [f.split()[0] for f in READ.split(", ")]
            kinds = [pa.string() if f.endswith("string") else pa.int64() for f in READ.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    return joined.mapInArrow(run, READ)


def op10_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public
    text = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)],
                                  "conv_id bigint, turn bigint, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    vocabulary = public.path("byte_bpe_50k.tiktoken")
    nodes, paths = prefix_tree(given.unionByName(extra), vocabulary, public.PATTERN)
    return read_back(nodes, paths, vocabulary, public.PATTERN)
