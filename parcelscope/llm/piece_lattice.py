"""SentencePiece encoding and decoding on a relational lattice.

A text is cut wherever no piece of the vocabulary spans the two characters
that meet (before every space, but also inside words); no path of the lattice
crosses such a cut, so the fragments between cuts can be encoded one by one,
and each distinct fragment once.  All its substrings up to the length of the
longest piece are exploded and equi-joined to the table of pieces; the
matches, the edges of its lattice, are grouped by fragment and folded with
the higher-order function ``aggregate``:

* unigram models: the Viterbi fold, best score per end position, ties to the
  longer last piece as the library does;
* BPE models: scores are merge ranks, and the path of the best sum is not
  the library's encoding.  There the fold takes, as often as it can, the
  edge of the best rank (leftmost first) that joins exactly two symbols.

Either way a character without a piece is an edge of its own and becomes the
pieces of its UTF-8 bytes.

Texts are put together again by block, a run of rows of one task with at most
``block_bytes`` of text: a block's distinct fragments go to the lattice and
come back to the block, so what is shuffled is each block's vocabulary and
its texts once, compressed, and no occurrence of a fragment.  Blocks are found
twice and must come out alike, so the input has to give the same rows in the
same order each time (a stored table does; a mismatch raises).

Edge cases.  A null or empty text has no pieces and decodes to the empty
text.  U+2581 in a text is read as a space, as in the library.  Repeated rows
and ids are returned as often as they came in; a null id stays null; an empty
table gives no rows; other columns are ignored.  A fragment longer than a bit
mask holds (62 characters) is merged by a priority queue instead of the fold.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelscope.llm.common import slices, stored, table

META = "▁"
BLOCK_BYTES = 8 << 20
MASK_CHARS = 62
RUN_WORDS = 1 << 17     # words of a slice that become ids at a time
BROADCAST_PIECES = 1_000_000
ENCODED = "row_id bigint, ids array<int>"
DECODED = "row_id bigint, n_pieces int, ids array<int>, n_decoded bigint, decoded_sha256 string"


class Vocabulary:
    """Pieces of a SentencePiece model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if (spec.model_type not in (spec.BPE, spec.UNIGRAM) or not spec.byte_fallback
                or spec.treat_whitespace_as_suffix or norm.precompiled_charsmap
                or norm.remove_extra_whitespaces or not norm.add_dummy_prefix
                or any(p.type == p.USER_DEFINED for p in model.pieces)):
            raise ValueError(f"{path}: not a byte-fallback model with the identity normalizer")
        self.bpe = spec.model_type == spec.BPE
        self.names = [p.piece for p in model.pieces]
        self.normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == p.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == p.BYTE}
        self.control = {i for i, p in enumerate(model.pieces) if p.type in (p.CONTROL, p.UNKNOWN)}
        self._names = pa.array(list(self.normal), pa.string())
        self._ids = np.array([i for i, _ in self.normal.values()], np.int32)
        self.longest = max(map(len, self.normal), default=1)
        # the library's score of an unknown character
        self.unknown = min((s for _, s in self.normal.values()), default=0.0) - 10.0
        met = {ord(a) << 21 | ord(b) for p in self.normal for a, b in zip(p, p[1:])}
        self.met = np.append(np.array(sorted(met), np.int64), np.iinfo(np.int64).max)
        # of characters under 256: whether no piece has both side by side
        self._parted = np.ones(1 << 16, bool)
        self._parted[[(pair >> 21) << 8 | pair & 255 for pair in met if pair >> 21 < 256 and pair & 0x1FFFFF < 256]] = False
        # parts the pieces of a spelled fragment; a character of no piece, so
        # in a text it is a fragment of its own
        used = set("".join(self.normal))
        self.mark = next(chr(c) for c in range(1, 0x110000) if chr(c) not in used)

    def fragments(self, words: pa.Array) -> tuple[list[str], np.ndarray]:
        """All fragments of the words, end to end, and how many each has."""
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_py()
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        if not len(points):
            return [], np.zeros(len(words), np.int64)
        a, b = points[:-1], points[1:]
        cut = np.append(True, self._parted[(a & 255) << 8 | (b & 255)])
        wide = np.flatnonzero((a | b) > 255)
        pair = a[wide].astype(np.int64) << 21 | b[wide]
        cut[wide + 1] = self.met[np.searchsorted(self.met, pair)] != pair
        length = pc.utf8_length(words).to_numpy().astype(np.int64)
        first = np.cumsum(length) - length
        cut[first[length > 0]] = True
        at = np.flatnonzero(cut)
        ends = np.append(at[1:], len(points))
        counts = np.add.reduceat(np.append(cut, False).astype(np.int64), first) if len(words) else first
        counts[length == 0] = 0
        return [text[a:b] for a, b in zip(at.tolist(), ends.tolist())], counts

    def merged(self, fragment: str) -> list[int]:
        """Starts of the pieces of one long fragment, by a priority queue."""
        n = len(fragment)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue: list[tuple[float, int, int]] = []

        def push(i: int) -> None:
            if i >= 0 and end[i] < n and end[end[i]] - i <= self.longest:
                known = self.normal.get(fragment[i:end[end[i]]])
                if known:
                    heapq.heappush(queue, (-known[1], i, end[end[i]]))

        for i in range(n - 1):
            push(i)
        while queue:
            _, i, stop = heapq.heappop(queue)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
            push(before[i])
            push(i)
        return [i for i in range(n) if alive[i]]

    def ids(self, spelled: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Fragments whose pieces are parted by the mark: without the marks,
        all their piece ids end to end, and how many each has."""
        names, alone = pc.replace_substring(spelled, self.mark, ""), pc.equal(spelled, self.mark)
        lists = pc.split_pattern(spelled, self.mark)
        if pc.any(alone).as_py():
            names = pc.if_else(alone, spelled, names)
            lists = pc.if_else(alone, pa.scalar([self.mark], lists.type), lists)
        pieces = lists.flatten()
        at = pc.fill_null(pc.index_in(pieces, value_set=self._names), -1).to_numpy()
        known = at >= 0
        spelled_bytes = [p.encode() for p in _strings(pieces.filter(pa.array(~known)))]
        size = np.ones(len(at), np.int64)
        size[~known] = np.fromiter(map(len, spelled_bytes), np.int64, len(spelled_bytes))
        ids = np.empty(int(size.sum()), np.int32)
        first = np.cumsum(size) - size
        ids[first[known]] = self._ids[at[known]]
        ids[_ranges(first[~known], size[~known])] = [self.bytes[x] for b in spelled_bytes for x in b]
        return _strings(names), ids, _sums(size, pc.list_value_length(lists).to_numpy())

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(self._spelled[ids].tolist()).decode("utf-8", "replace").replace(META, " ")
        return text[1:] if text[:1] == " " else text

    def read_back(self, rows: pa.Array, lists: pa.ListArray) -> pa.RecordBatch:
        """Rows and their ids with what the ids decode to: length, digest."""
        flat, cut = lists.flatten().to_numpy(), np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
        length, digest = [], []
        for a, b in zip(cut[:-1], cut[1:]):
            text = self.decode(flat[a:b])
            length.append(len(text))
            digest.append(hashlib.sha256(text.encode()).hexdigest())
        return pa.RecordBatch.from_arrays(
            [rows, pa.array(np.diff(cut), pa.int32()), lists, pa.array(length, pa.int64()),
             pa.array(digest, pa.string())], ["row_id", "n_pieces", "ids", "n_decoded", "decoded_sha256"])

    @property
    def _spelled(self) -> np.ndarray:
        """Bytes of each piece; none for control pieces."""
        if not hasattr(self, "_out"):
            self._out = np.array([b"" if i in self.control else n.encode() for i, n in enumerate(self.names)], object)
            for b, i in self.bytes.items():
                self._out[i] = bytes([b])
        return self._out


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


def _word_lists(texts: pa.Array) -> pa.ListArray:
    """Words of each text (null and empty: none).  Every word but those that
    begin with a line feed stands for itself after a space."""
    texts = pc.fill_null(texts, "")
    plain = pc.replace_substring(pc.replace_substring(texts, META, " "), "\n", " \n")
    lists = pc.split_pattern(plain, " ")
    return pc.if_else(pc.equal(texts, ""), pa.scalar([], lists.type), lists)


def _strings(values: pa.Array) -> list[str]:
    return values.to_numpy(zero_copy_only=False).tolist()


def _spell(words: pa.Array) -> pa.Array:
    return pc.if_else(pc.starts_with(words, "\n"), words, pc.binary_join_element_wise(META, words, ""))


def _with_runs(words: pa.Array, lengths: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words of rows of the given lengths, where empty words (a space with a
    space behind it) are joined to the next word as META characters, so that
    runs stay together.  The last word of a row and a word before a line feed
    stay as they are."""
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
    if not empty.any():
        return words, lengths
    ends = np.cumsum(lengths)
    goes = empty & ~np.append(pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)[1:], True)
    goes[ends[lengths > 0] - 1] = False
    stay = np.flatnonzero(~goes)
    run = np.diff(stay, prepend=-1) - 1
    lengths = lengths - _sums(goes.astype(np.int64), lengths)
    words, joined = words.take(pa.array(stay)), run > 0
    after = words.filter(pa.array(joined)).to_pylist()
    return pc.replace_with_mask(words, pa.array(joined), pa.array(
        [META * r + w for r, w in zip(run[joined].tolist(), after)], words.type)), lengths


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of about 4 MB with the number of their block."""
    task, block, held = TaskContext.get().partitionId(), 0, 0
    for part in slices(batches, 1):
        size = part.column(1).nbytes if part.num_rows else 0
        if held and held + size > most:
            block, held = block + 1, 0
        held += size
        yield task << 32 | block, part


class Coder:
    """Words of one slice: (row lengths, word codes, spelled words)."""

    def __init__(self, texts: pa.Array):
        lists = _word_lists(texts)
        words, self.lengths = _with_runs(lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        coded = pc.dictionary_encode(words)
        self.codes = coded.indices.to_numpy()
        self.words = _spell(coded.dictionary)


def pieces_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    rows = [(p, i, float(s)) for p, (i, s) in vocabulary.normal.items()]
    pieces = spark.createDataFrame(rows, "piece string, id int, score double")
    return F.broadcast(pieces) if len(rows) <= BROADCAST_PIECES else pieces


def _bit(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), k.cast("int"))


def _merge_fold(edges: Column, n: Column) -> Column:
    """Mask of the symbol boundaries left after all merges; edges are sorted
    by rank and start, ``ends`` and ``inner`` are masks of their bounds."""
    def step(mask: Column, _: Column) -> Column:
        ready = F.filter(edges, lambda e: (mask.bitwiseAND(e["ends"]) == e["ends"])
                         & (F.bit_count(mask.bitwiseAND(e["inner"])) == 1))
        return mask.bitwiseAND(F.bitwise_not(F.coalesce(F.get(ready, F.lit(0))["inner"], F.lit(0).cast("bigint"))))

    return F.aggregate(F.sequence(F.lit(1), n - 1), _bit(n + 1) - 1, step)


def _viterbi_fold(edges: Column) -> Column:
    """``array<struct<score, s>>`` per end position 0..n: the best score and
    the start of its last piece; edges are sorted by end and start."""
    node = "struct<score: double, s: int>"

    def at(score: Column, s: Column) -> Column:
        return F.struct(score.alias("score"), s.cast("int").alias("s")).cast(node)

    def step(best: Column, e: Column) -> Column:
        total = F.get(best, e["s"])["score"] + e["score"]
        new = F.array(at(total, e["s"]))
        return (F.when(F.size(best) == e["t"], F.concat(best, new))
                .when(total > F.get(best, e["t"])["score"], F.concat(F.slice(best, 1, e["t"]), new))
                .otherwise(best))

    return F.aggregate(edges, F.array(at(F.lit(0.0), F.lit(-1))), step)


def encode_fragments(fragments: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(fragment, cuts)`` by lattice and fold: where the pieces of each
    distinct fragment end.  Fragments in which no piece of several characters
    occurs have no row: each of their characters stands alone."""
    n = F.length("fragment")
    pieces = pieces_table(fragments.sparkSession, vocabulary)
    least = 2 if vocabulary.bpe else 1      # merges start from single characters
    # two explodes of numbers are compiled with the join, nested lambdas that
    # make an array of substrings are not; coalesce: no filter that cuts twice
    spans = (fragments.where(n >= 2)
             .select("fragment", F.explode_outer(F.sequence(F.lit(0), n - least)).alias("s"))
             .select("fragment", "s", F.explode_outer(F.sequence(
                 F.lit(least), F.least(F.lit(vocabulary.longest), n - F.col("s")))).alias("k")))
    piece = F.coalesce(F.substring("fragment", F.col("s") + 1, F.col("k")), F.lit(""))
    matched = spans.select("fragment", "s", (F.col("s") + F.col("k")).alias("t"), piece.alias("piece")).join(pieces, "piece")
    if vocabulary.bpe:
        edges = matched.groupBy("fragment").agg(F.sort_array(F.collect_list(F.struct(
            (-F.col("score")).alias("cost"), "s", "t"))).alias("edges"))
        masked = edges.select("fragment", n.alias("n"), F.transform("edges", lambda e: F.struct(
            (_bit(e["s"]) + _bit(e["t"])).alias("ends"), (_bit(e["t"]) - _bit(e["s"] + 1)).alias("inner"))).alias("edges"))
        # a column that only a lambda reads would be computed again in every
        # step; naming it outside the lambda too keeps it computed once a row
        folded = masked.select("fragment", "n", F.when(
            F.size("edges") > 0, _merge_fold(F.col("edges"), F.col("n"))).alias("mask"))
        return folded.select("fragment", F.when(F.col("mask") != 0, F.filter(
            F.sequence(F.lit(1), F.col("n")), lambda k: F.col("mask").bitwiseAND(_bit(k)) != 0)).alias("cuts"))
    edges = matched.groupBy("fragment").agg(F.collect_list(F.struct("t", "s", "score")).alias("edges"))
    known = F.transform(F.filter("edges", lambda e: e["t"] == e["s"] + 1), lambda e: e["s"])
    missing = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), known), lambda s: F.struct(
        (s + 1).alias("t"), s.alias("s"), F.lit(vocabulary.unknown).alias("score")))
    ordered = edges.select("fragment", n.alias("n"), F.sort_array(F.concat("edges", missing)).alias("edges"))
    best = ordered.select("fragment", "n", _viterbi_fold(F.col("edges")).alias("best"))
    # back from the end: each end position on the best path names the one before
    walk = F.aggregate(
        F.sequence(F.col("n"), F.lit(1), F.lit(-1)),
        F.struct(F.col("n").alias("at"), F.array().cast("array<int>").alias("cuts")),
        lambda w, t: F.when(w["at"] == t, F.struct(
            F.get(F.col("best"), t)["s"].alias("at"), F.concat(w["cuts"], F.array(t)).alias("cuts"))).otherwise(w))
    return best.select("fragment", F.when((F.col("n") > 0) & (F.size("best") > 0), F.sort_array(walk["cuts"])).alias("cuts"))


def _spelled(cuts: DataFrame, mark: str) -> DataFrame:
    """``(spelled)``: the fragments of ``(fragment, cuts)`` with the mark
    between their pieces."""
    def piece(i: Column) -> Column:
        start = F.coalesce(F.get("cuts", i - 1), F.lit(0))
        return F.substring("fragment", start + 1, F.get("cuts", i) - start)

    # no filter here: it would be moved, with the fold inside it, below the fold
    return cuts.select(F.array_join(
        F.transform(F.sequence(F.lit(0), F.size("cuts") - 1), piece), mark).alias("spelled"))


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(row_id, ids)`` for every row: the piece ids of its whole text.  With
    ``decoded`` the rows are decoded where they are put together, which gives
    the columns of ``with_decoded``.  Larger blocks repeat fewer fragments in
    the shuffle and hold more in a task; the result is the same."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("body"))
    vocabulary = load(model_path)

    def vocabulary_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words, names, at = load(model_path), set(), set(), None

        def emit():
            ordered = sorted(names)
            for k in range(0, len(ordered), 1 << 16):
                part = pa.array(ordered[k:k + (1 << 16)], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), at)), part], ["block", "fragment"])
            words.clear()
            names.clear()

        for block, part in _blocks(batches, block_bytes):
            if block != at and names:
                yield from emit()
            at = block
            found = Coder(part.column(1)).words
            listed = _strings(found)
            fresh = found.filter(pa.array([w not in words for w in listed], pa.bool_()))
            words.update(listed)
            names.update(own.fragments(fresh)[0])
        if names:
            yield from emit()

    def text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=5)
        for block, part in _blocks(batches, block_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema) as out:
                out.write_batch(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), pa.array([pack.compress(sink.getvalue())], pa.binary())],
                ["block", "packed"])

    parts = stored(rows.mapInArrow(vocabulary_rows, "block bigint, fragment string"), "block_fragments")
    # a fragment becomes many substrings: more partitions than its bytes ask for
    spread = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = parts.select("fragment").repartition(spread, "fragment").distinct()
    if vocabulary.bpe:
        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = load(model_path)
            for b in batches:
                out = []
                for name in b.column(0).to_pylist():
                    starts = own.merged(name)
                    out.append(own.mark.join(name[i:j] for i, j in zip(starts, [*starts[1:], len(name)])))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["spelled"])

        short = F.length("fragment") <= MASK_CHARS - 1
        coded = _spelled(encode_fragments(distinct.where(short), vocabulary), vocabulary.mark).unionByName(
            distinct.where(~short).mapInArrow(merged, "spelled string"))
    else:
        coded = _spelled(encode_fragments(distinct, vocabulary), vocabulary.mark)
    coded = stored(coded, "coded_fragments")
    # the fragment is its spelling without the marks, so it is not shuffled twice
    single = F.array_join(F.transform(F.sequence(F.lit(1), F.length("fragment")),
                                      lambda i: F.substring("fragment", i, F.lit(1))), vocabulary.mark)
    # a row per distinct fragment: packed, its file is small enough for a
    # broadcast that would be many times as large
    whole = F.replace("spelled", F.lit(vocabulary.mark), F.lit(""))
    book = (parts.join(coded.hint("merge"), F.col("fragment") == whole, "left")
            .select("block", F.coalesce("spelled", single).alias("spelled")))

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        own, unpack = load(model_path), zstandard.ZstdDecompressor()
        # every fragment's ids end to end in one array
        number, numbers, sizes = {}, [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for at in range(0, right.num_rows, 1 << 16):
            for chunk in right["spelled"].slice(at, 1 << 16).chunks:
                names, found, size = own.ids(chunk)
                number.update(zip(names, range(len(number), len(number) + len(names))))
                numbers.append(found)
                sizes.append(size)
        flat, size = np.concatenate(numbers), np.concatenate(sizes)
        start = np.cumsum(size) - size
        out_ids, out_rows = [], []
        for packed in left["packed"]:
            for part in pa.ipc.open_stream(unpack.decompress(packed.as_py())):
                coder = Coder(part.column(1))
                spelled, count = own.fragments(coder.words)
                try:
                    which = np.fromiter((number[f] for f in spelled), np.int64, len(spelled))
                except KeyError as missing:
                    raise ValueError("the input gave other rows the second time: store it first") from missing
                first = np.cumsum(count) - count
                word = np.append(0, np.cumsum(coder.lengths))
                for a, b in _runs(word):
                    # words to fragments, rows to words, then fragments to ids
                    codes = coder.codes[word[a]:word[b]]
                    seq = which[_ranges(first[codes], count[codes])]
                    ids = flat[_ranges(start[seq], size[seq])]
                    per_row = _sums(size[seq], _sums(count[codes], coder.lengths[a:b]))
                    ends = np.append(0, np.cumsum(per_row))
                    out_ids.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())))
                    out_rows.append(part.column(0).slice(a, b - a))
        if not decoded:
            return pa.table({"row_id": pa.chunked_array(out_rows, pa.int64()),
                             "ids": pa.chunked_array(out_ids, pa.list_(pa.int32()))})
        return pa.Table.from_batches([own.read_back(r, i) for r, i in zip(out_rows, out_ids)],
                                     None if out_rows else own.read_back(pa.array([], pa.int64()), pa.array(
                                         [], pa.list_(pa.int32()))).schema)

    texts = rows.mapInArrow(text_rows, "block bigint, packed binary")
    return texts.groupBy("block").cogroup(book.groupBy("block")).applyInArrow(put_together,
                                                                              DECODED if decoded else ENCODED)


def _runs(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most RUN_WORDS words (or one row of more); row k's
    words are ends[k] to ends[k + 1]."""
    a, n = 0, len(ends) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + RUN_WORDS, "right")) - 1)
        yield a, b
        a = b


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ..., for size[0] numbers, then start[1], ..."""
    total = int(size.sum())
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)


def _sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of the given lengths."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(row_id, text)`` from ``(row_id, ids)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [own.decode(x.values.to_numpy()) for x in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["row_id", "text"])

    return encoded.select("row_id", "ids").mapInArrow(run, "row_id bigint, text string")


def with_decoded(encoded: DataFrame, model_path: str) -> DataFrame:
    """``(row_id, n_pieces, ids, n_decoded, decoded_sha256)`` from ``(row_id,
    ids)``: each row's ids with the length in characters and the digest of
    the text that they decode to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                yield own.read_back(b.column(0), b.column(1))

    return encoded.select("row_id", "ids").mapInArrow(run, DECODED)


def op9_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    model = public_tokenizers.path("piece_bpe_32k.model")
    found = encode(table(spark, sf_dir, "documents"), model, decoded=True, block_bytes=32 << 20)
    return found.withColumnRenamed("row_id", "doc_id")
