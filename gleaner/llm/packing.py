"""Best-fit packing of token pieces into sequences of a fixed capacity, in bulk-synchronous rounds.

A round takes all pieces of one length, longest first. Pieces and open gaps are ordered by size; a successor
sweep matches the pieces with the smallest gaps that hold them, ranks settle which piece gets which gap, the gaps
shrink, and the next round begins. Sizes are whole numbers up to the capacity, so the ordered pieces and gaps are
kept as ranges - (length, first rank, last rank) and (gap, first sequence, last sequence) - and the sweep works on
ranges whose number depends on the capacity alone, not on the input. What grows with the input is distributed:
lengths are counted by partial aggregation, pieces are ranked within their length bucket by bucket, and every
piece finds its range by binary search in the broadcast plan (at most MAX_RANGES rows).

This is best-fit decreasing: the matches equal those of placing pieces one by one.

Defined cases: a null text is empty and has the closing id alone; a document of at most the capacity is one piece;
a longer one is cut into pieces of the capacity, the first of which may be shorter. Repeated rows are packed as
often as they occur; a null doc_id is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._common import numbered_within, stored, use_small_arrow_batches

CAPACITY = 2048
END_ID = 0
CACHE_UNITS = 600_000
MAX_RANGES = 2_000_000


class SpacedTokenizer:
    """Ids as the tokenizers library gives them for a byte-level BPE file whose words take their leading space.

    Every space between two other characters begins a word, so the parts of a text from space to space are encoded
    independently and kept in a cache. tiktoken encodes new parts where the file's ids are the ranks of its merges,
    else the library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        self.fast = self._ranked(spec)
        self.merge = self.fast._core_bpe.encode_single_piece if self.fast is not None else None
        self.cache: dict[str, bytes | None] = {}

    @staticmethod
    def _ranked(spec: dict):
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) or spec["normalizer"] or pre.get("type") != "ByteLevel" or not pre.get("use_regex") or pre.get("add_prefix_space"):
            return None
        import tiktoken

        merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if [model["vocab"].get(t) for t in merged] != list(range(256, 256 + len(merged))):
            return None
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        specials = {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in specials}
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("file", pat_str=words, mergeable_ranks=ranks, special_tokens={})

    def part(self, text: str) -> bytes:
        ids = self.fast.encode_ordinary(text) if self.fast is not None else self.library.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def spaced(self, word: str) -> bytes | None:
        """Ids of a space and a word; None if white space at the word's ends joins the space."""
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        if word.isalpha():
            return array("I", self.merge(b" " + word.encode())).tobytes()
        if word[-1] in ".,;:!?" and word[:-1].isalpha():
            return array("I", self.merge(b" " + word[:-1].encode()) + self.merge(word[-1].encode())).tobytes()
        return self.part(" " + word)

    def encode(self, text: str) -> bytes:
        """A whole text's ids as little-endian numbers."""
        if any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        if self.fast is None:
            return self.part(text)
        first, *rest = text.split(" ")
        if not first or first[-1].isspace():
            return self.part(text)
        cache = self.cache
        try:
            found = [cache[w] for w in rest]
        except KeyError:
            found = []
            for w in rest:
                if w not in cache:
                    if len(cache) >= CACHE_UNITS:
                        cache.clear()
                    cache[w] = self.spaced(w)
                found.append(cache[w])
        return self.part(text) if None in found else self.part(first) + b"".join(found)


@functools.cache
def tokenizer_of(path: str) -> SpacedTokenizer:
    """One for each worker process, whose cache lasts from task to task."""
    return SpacedTokenizer(path)


def _pieces(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        for batch in batches:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = tokenizer.encode(text or "") + END_ID.to_bytes(4, "little")
                n = len(data) // 4
                edges = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    part = data[4 * a : 4 * b]
                    doc.append(doc_id), piece.append(k), start.append(a), length.append(b - a), crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<i4"))
            columns = {"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    return run


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Where all pieces of each length go: (length, first rank, first sequence, pieces a sequence, offset).

    A range ends where the next one of that length begins. The piece of rank r goes to the sequence
    first + (r - first rank) // pieces, at offset + (r - first rank) % pieces * length.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    used = 0
    for length in sorted(counts, reverse=True):
        left, rank, size = counts[length], 0, length
        while left and size < capacity:  # successor sweep: the smallest gaps first
            if not gaps[size]:
                size += 1
                continue
            first, last = gaps[size].pop()
            fit, at = size // length, capacity - size
            whole = min(last - first, left // fit)
            if whole:
                plan.append((length, rank, first, fit, at))
                gaps[size - fit * length].append((first, first + whole))
                rank, left, first = rank + whole * fit, left - whole * fit, first + whole
            if left and first < last:  # fewer pieces than fit into one more gap
                plan.append((length, rank, first, left, at))
                gaps[size - left * length].append((first, first + 1))
                rank, left, first = rank + left, 0, first + 1
            if first < last:
                gaps[size].append((first, last))
        if left:
            fit = capacity // length
            plan.append((length, rank, used, fit, 0))
            whole, rest = divmod(left, fit)
            if whole:
                gaps[capacity - fit * length].append((used, used + whole))
            if rest:
                gaps[capacity - rest * length].append((used + whole, used + whole + 1))
            used += whole + bool(rest)
    return plan


def _placer(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value  # sorted by length, rank
        shift = np.int64(1) << 48
        keys = plan[:, 0] * shift + plan[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            row = plan[np.searchsorted(keys, length * shift + rank, side="right") - 1]
            within = rank - row[:, 1]
            sequence, offset = row[:, 2] + within // row[:, 3], row[:, 4] + within % row[:, 3] * length
            kept = [c for c in batch.schema.names if c != "__rank"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*kept, "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces, a stored table with doc_id and length (1 to capacity)."""
    spark = pieces.sparkSession
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    plan = sorted(best_fit_plan(counts, capacity))
    if len(plan) > MAX_RANGES:
        raise ValueError("the plan has too many ranges to broadcast; lower the capacity")
    held = spark.sparkContext.broadcast(np.array(plan, dtype=np.int64).reshape(-1, 5))
    ranked = numbered_within(pieces, ["length"], ["doc_id", "piece"], "__rank", sum(counts.values()), "doc_id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_placer(held), schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds ids."""
    use_small_arrow_batches(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = stored(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_pieces(path, capacity, with_ids), schema), "pieces")
    return pack_pieces(pieces, capacity)
