"""Byte-pair encoding with forced-boundary splitting, and decoding.

A byte pair that occurs inside no vocabulary token can't be spanned by any merge, so a word may be cut between
the two bytes and its fragments encoded independently; their ids, concatenated, are the word's ids. White space
occurs inside no token of a word vocabulary, so it is such a boundary too. `ForcedBoundaryTokenizer` takes a
tokenizers file with a BPE model, uses that file's own normalizer and pre-tokenizer, cuts every word at all
forced boundaries and encodes fragments with the file's vocabulary and merges. Special tokens in a text are found
first, as the tokenizers library does.

Units between white space are kept in a cache of CACHE_UNITS entries, which bounds a worker's memory; a text with
characters for which cutting at white space before normalising isn't known to be safe is one unit as a whole.
Nothing is shuffled: one narrow stage, a task's memory is a batch of texts and the cache.

Defined cases: a null text is empty; an empty text has no ids, its decoded text is empty. Repeated rows and null
ids are encoded like all others; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gleaner.llm._common import use_small_arrow_batches

CACHE_UNITS = 400_000
END_OF_WORD = b"\xff"
# The normalizer and pre-tokenizer of the lower-case word vocabulary, and its word pattern.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLITTER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
WORDS = regex.compile(PATTERN)
#: Characters that normalise one by one, none of them a combining mark; white space among them is that of ASCII.
SAFE = re.compile("[\t\n\r\x20-\x7e¡-įı-ſ‐-‧‰-⁞€]*")


class ForcedBoundaryTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("ignore_merges") or model.get("byte_fallback"):
            raise ValueError("a plain BPE model is needed")
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.simple = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == SPLITTER
        suffix = model.get("end_of_word_suffix") or ""
        merged = [a + b for a, b in (m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
        merged = [a.replace(suffix, "", a.count(suffix) - 1) if suffix and a.count(suffix) > 1 else a for a in merged]
        ids = [model["vocab"][t] for t in merged]
        if ids != sorted(ids) or len({*ids}) < len(ids):
            raise ValueError("ids must follow the order of the merges")
        # the byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        # the end of a word is a byte that no text in UTF-8 has; each last letter joins it before any other merge
        self.end = END_OF_WORD if suffix else b""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {self._bytes(t.removesuffix(suffix)) + self.end if suffix and t.endswith(suffix) else self._bytes(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.joinable = bytearray(1 << 16)
        for t in ranks:
            for pair in zip(t, t[1:], strict=False):
                self.joinable[pair[0] << 8 | pair[1]] = 1
        import tiktoken

        self.merge = tiktoken.Encoding("file", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.find_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.mark = os.path.commonprefix([*self.special])  # of all special tokens; a text without it has none
        self.name = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        self.cache: dict[bytes, tuple[bytes, bytes]] = {}  # by word
        self.units: dict[str, tuple[bytes, bytes]] = {}

    def _bytes(self, shown: str) -> bytes:
        return bytes(self.byte[c] for c in shown)

    def fragments(self, word: bytes) -> list[bytes]:
        """The word cut between any two neighbours that occur side by side in no token."""
        joinable, cuts = self.joinable, [0]
        for i in range(1, len(word)):
            if not joinable[word[i - 1] << 8 | word[i]]:
                cuts.append(i)
        if len(cuts) == 1:
            return [word]
        return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)], strict=True)]

    def words(self, text: str) -> list[bytes]:
        """The words that the file's own normalizer and pre-tokenizer find."""
        if self.simple and SAFE.fullmatch(text) is not None:
            return [w.encode() for w in WORDS.findall(text.lower())]
        if self.normalizer is not None:
            text = self.normalizer.normalize_str(text)
        return [self._bytes(w) for w, _ in self.splitter.pre_tokenize_str(text)]

    def word(self, word: bytes) -> tuple[bytes, bytes]:
        """A word's ids as little-endian numbers, and its tokens joined by spaces."""
        if (found := self.cache.get(word)) is None:
            ids = [i for part in self.fragments(word + self.end) for i in self.merge(part)]
            if len(self.cache) >= CACHE_UNITS:
                self.cache.clear()
            found = self.cache[word] = array("I", ids).tobytes(), " ".join([self.name[i] for i in ids]).encode()
        return found

    def packed(self, words: list[bytes]) -> tuple[bytes, bytes]:
        done = [self.word(w) for w in words]
        return b"".join([i for i, _ in done]), b" ".join([d for _, d in done])

    def unit(self, text: str) -> tuple[bytes, bytes]:
        """The same of a unit without white space, all its characters safe."""
        if self.simple:
            if text.isalpha():
                return self.word(text.lower().encode())
            if text[-1] in ".,;:!?" and text[:-1].isalpha():
                return self.packed([text[:-1].lower().encode(), text[-1].encode()])
        return self.packed(self.words(text))

    def encode_decode(self, text: str) -> tuple[bytes, bytes]:
        """A whole text's ids as little-endian numbers, and the text that they decode to."""
        if self.find_special is not None and self.mark in text and (sections := self.find_special.split(text))[1:]:
            units = [(array("I", [self.special[s]]).tobytes(), s.encode()) if k % 2 else self.packed(self.words(s)) for k, s in enumerate(sections)]
        elif SAFE.fullmatch(text) is None:
            units = [self.packed(self.words(text))]
        else:
            words, cache = text.split(), self.units
            try:
                units = [cache[w] for w in words]
            except KeyError:
                units = []
                for w in words:
                    if (u := cache.get(w)) is None:
                        if len(cache) >= CACHE_UNITS:
                            cache.clear()
                        u = cache[w] = self.unit(w)
                    units.append(u)
        return b"".join([u[0] for u in units]), b" ".join([u[1] for u in units if u[0]])


@functools.cache
def tokenizer_of(path: str) -> ForcedBoundaryTokenizer:
    """One for each worker process, whose caches last from task to task."""
    return ForcedBoundaryTokenizer(path)


def _rows(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(path)
        for batch in batches:
            done = [tokenizer.encode_decode(t or "") for t in batch.column("text").to_pylist()]
            columns = {
                "doc_id": batch.column("doc_id"),
                "n_tokens": pa.array([len(i) // 4 for i, _ in done], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i, _ in done], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for _, d in done], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array([memoryview(i).cast("I").tolist() for i, _ in done], pa.list_(pa.int32()))
                columns["decoded"] = pa.array([d.decode() for _, d in done], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return run


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with_ids adds ids and decoded.

    path: a tokenizers file without a decoder, present on every executor; decoding joins tokens by spaces.
    """
    use_small_arrow_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_rows(path, with_ids), schema)
