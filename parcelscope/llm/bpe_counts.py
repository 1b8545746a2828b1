"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens at white space (no piece of the vocabulary
spans such a cut; checked when the vocabulary is loaded).  The distinct
pre-tokens of a slice of rows lie end to end in one array of symbols.  In
each round every sequence finds its lowest-rank adjacent pair and merges all
its occurrences at once, until no pair is left; the symbols that survive are
counted.  Merging all occurrences at once equals merging the leftmost one by
one unless the new symbol takes part in a pair of no higher rank; for such
symbols, marked when the vocabulary is loaded, only the leftmost occurrence
is merged in a round.

The vocabulary is a SentencePiece BPE model with byte fallback, named by its
path and loaded once per Python worker; a character without a piece counts
one token per UTF-8 byte.  Begin, end and other control pieces are never
added and never matched in a text.

Edge cases.  A null or empty text has no bytes and no tokens.  Repeated rows
and ids are returned as often as they came in; a null id stays null; an
empty table gives no rows; other columns are ignored.  A text may be of any
length: nothing is cut off.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelscope.llm.common import slices, table

META = "▁"                  # stands for a space inside pieces
PIECE_LIMIT = 1 << 18       # pre-tokens kept with their counts in a worker
COUNTS = "row_id bigint, n_bytes bigint, n_tokens bigint"
NONE = np.iinfo(np.int32).max


class Merges:
    """Pair table of a SentencePiece BPE model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        normal = {p.piece: p.score for p in model.pieces if p.type == p.NORMAL}
        if (spec.model_type != spec.BPE or not spec.byte_fallback or spec.treat_whitespace_as_suffix
                or norm.precompiled_charsmap or norm.remove_extra_whitespaces
                or not norm.add_dummy_prefix or any(p.type == p.USER_DEFINED for p in model.pieces)):
            raise ValueError(f"{path}: not a byte-fallback BPE model with the identity normalizer")
        if any(META in p.lstrip(META) or (len(p) > 1 and "\n" in p) for p in normal):
            raise ValueError(f"{path}: a piece spans a white-space cut")
        names = list(normal)
        self.ids = {p: i for i, p in enumerate(names)}
        scores = np.array([normal[p] for p in names])
        _, rank = np.unique(-scores, return_inverse=True)   # equal scores share a rank
        keys, merged = [], []
        self.alone = np.zeros(len(names), bool)             # merge only the leftmost
        for p, whole in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is None or b is None:
                    continue
                keys.append(a << 32 | b)
                merged.append(whole)
                for part in (a, b):
                    if rank[whole] <= rank[part]:
                        self.alone[part] = True
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.merged = np.append(np.array(merged, np.int32)[order], 0)
        self.rank = np.append(rank[self.merged[:-1]].astype(np.int32), NONE)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.known: dict[str, int] = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE without a piece) and merged symbol of adjacent pairs."""
        want = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.searchsorted(self.keys, want)
        found = (self.keys[at] == want) & (left >= 0) & (right >= 0)
        return np.where(found, self.rank[at], NONE), self.merged[at]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token (spaces already replaced, none empty)."""
        n = len(words)
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
        length = np.fromiter(map(len, words), np.int64, n)
        seq = np.repeat(np.arange(n), length)
        sym = self.char[points]
        # a character without a piece: one token per UTF-8 byte
        extra = np.where(sym < 0, (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF), 0)
        out = np.bincount(seq, extra, n).astype(np.int64)
        rank = np.full(len(sym), NONE, np.int32)
        into = np.zeros(len(sym), np.int32)
        if len(sym) > 1:
            rank[:-1], into[:-1] = self.look_up(sym[:-1], sym[1:])
            rank[:-1][seq[:-1] != seq[1:]] = NONE
        while len(sym):
            start = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            size = np.diff(np.append(start, len(seq)))
            low = np.minimum.reduceat(rank, start)
            done = low == NONE
            out[seq[start[done]]] += size[done]
            if done.all():
                break
            if done.any():
                keep = np.repeat(~done, size)
                seq, sym, rank, into = seq[keep], sym[keep], rank[keep], into[keep]
                size, low = size[~done], low[~done]
            hit = np.flatnonzero(rank == np.repeat(low, size))
            first = np.append(True, seq[hit[1:]] != seq[hit[:-1]])
            # overlapping occurrences (aaa): every second one of a run, from the left
            run = np.append(True, np.diff(hit) > 1) | first
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            lead = into[hit[first]][np.cumsum(first) - 1]
            hit = hit[first | ((place % 2 == 0) & ~self.alone[lead])]
            sym[hit] = into[hit]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))          # one symbol left of each is gone
            seq, sym, rank, into = seq[stay], sym[stay], rank[stay], into[stay]
            near = np.concatenate((at, at[at > 0] - 1))     # may repeat, which does no harm
            last = near == len(sym) - 1
            rank[near[last]] = NONE
            near = near[~last]
            r, m = self.look_up(sym[near], sym[near + 1])
            rank[near] = np.where(seq[near] == seq[near + 1], r, NONE)
            into[near] = m
        return out

    def counts(self, words: list[str]) -> np.ndarray:
        """``count`` with the recent pre-tokens kept (bounded)."""
        known = self.known
        fresh = [w for w in words if w not in known]
        if len(known) + len(fresh) > PIECE_LIMIT:
            known.clear()
            fresh = words
        kept = dict(zip(fresh, self.count(fresh).tolist())) if fresh else {}
        if len(fresh) <= PIECE_LIMIT:
            known.update(kept)
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return np.fromiter(map(kept.__getitem__, words), np.int64, len(words))


@lru_cache(maxsize=2)
def load(path: str) -> Merges:
    return Merges(path)


def _odd_words(text: str) -> list[str]:
    """Pre-tokens of a text with runs of spaces, a leading space or META."""
    return re.findall(f"\n|{META}+[^{META}\n]*|[^{META}\n]+", META + text.replace(" ", META))


def token_counts(texts: pa.Array, merges: Merges) -> np.ndarray:
    texts = pc.fill_null(texts, "")
    odd = pc.or_(pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, META)),
                 pc.starts_with(texts, " "))
    out = np.zeros(len(texts), np.int64)
    # a line feed starts a word that has no space before it
    plain = pc.filter(texts, pc.invert(odd))
    words = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
    lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(words.flatten())
    spelled = [w if w[:1] == "\n" else META + w for w in coded.dictionary.to_pylist()]
    each = merges.counts(spelled)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    total = np.concatenate(([0], np.cumsum(each)))
    sums = total[ends] - total[ends - lengths]
    odd_mask = odd.to_numpy(zero_copy_only=False).astype(bool)
    out[~odd_mask] = np.where(pc.equal(plain, "").to_numpy(zero_copy_only=False), 0, sums)
    for i in np.flatnonzero(odd_mask):
        split = _odd_words(texts[int(i)].as_py())
        distinct = list(dict.fromkeys(split))
        value = dict(zip(distinct, merges.counts(distinct).tolist()))
        out[i] = sum(map(value.__getitem__, split))
    return out


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``(row_id, n_bytes, n_tokens)`` of every row's whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load(model_path)
        for part in slices(batches, 1):
            text = part.column(1)
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0).cast(pa.int64()), size, pa.array(token_counts(text, merges))],
                ["row_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("row_id"),
                       F.col(text_col).cast("string").alias("body"))
    return rows.mapInArrow(run, COUNTS)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers
    counted = count_tokens(table(spark, sf_dir, "documents"),
                           public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select(F.col("row_id").alias("doc_id"), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > 4096).alias("over_limit"))
