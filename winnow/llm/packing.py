"""Packing of tokenised documents into fixed-length sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.common import blocks_for, materialise

#: Pieces that one task packs; each such block leaves a few sequences unfilled.
PER_BLOCK = 16_000
_KEPT = 600_000  # words, and parts of words, whose ids a worker remembers


#: Texts of these characters alone are taken apart here: for them normalising is lower-casing, letters are what Python
#: calls so, and the pattern below cuts as the tokenizer's own does. All others go through the tokenizer as a whole.
_PLAIN = re.compile(r"[\x21-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]+")
_SEPARATOR = re.compile("[\x1c-\x1f]")
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def _byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Parts(dict):
    """A word or run of signs, in lower case -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, tokenizer: object) -> None:
        self.model, self.letters = tokenizer.model, _byte_letters()

    def __missing__(self, part: str) -> bytes:
        if len(self) > _KEPT:
            self.clear()
        mapped = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        self[part] = out = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(mapped)])
        return out


class _Ids(dict):
    """White-space-free stretch of text -> its ids as little-endian unsigned 32-bit numbers.

    Of the vocabulary's file, the pieces used are its model and, for unusual characters, the tokenizer as a whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.parts = _Parts(self.tokenizer)
        kinds = json.loads(self.tokenizer.to_str())
        self.special = [t["content"] for t in kinds["added_tokens"]]
        # what _PLAIN and _PART rely on
        self.known = (
            [n["type"] for n in (kinds["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in (kinds["pre_tokenizer"] or {}).get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in json.dumps(kinds["pre_tokenizer"]["pretokenizers"][0]).replace("\\\\", "\\")
        )

    def __missing__(self, word: str) -> bytes:
        if len(self) > _KEPT:
            self.clear()
        if self.known and _PLAIN.fullmatch(word) and not ("<|" in word and any(x in word for x in self.special)):
            out = b"".join(map(self.parts.__getitem__, _PART.findall(word.lower())))
        else:
            out = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = out
        return out


def _split(text: str) -> list[str]:
    """Cut where the tokenizer, too, sees white space; unlike Python it doesn't where the four separators stand."""
    return re.split(r"[ \t\n\r]+", text.strip(" \t\n\r")) if _SEPARATOR.search(text) else text.split()


def tokenise(documents: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32, and with_ids the ids themselves.

    The tokenizer drops white space and never joins what it separates, so that texts are encoded by their distinct
    white-space-free stretches, whose ids a worker remembers. Documents longer than `length` are cut; each gets `end_id`
    after its ids.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    names = schema.replace(" long", "").replace(" int", "").replace(" binary", "").split(", ")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Ids(tokenizer)
        for whole in batches:
            for at in range(0, len(whole), 1024):
                b = whole.slice(at, 1024)
                rows = []
                for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    words = _split(text or "")
                    ids = b"".join(map(known.__getitem__, words)) + end
                    for piece, start in enumerate(range(0, len(ids) // 4, length)):
                        part = ids[4 * start : 4 * (start + length)]
                        rows.append((doc_id, piece, start, len(part) // 4, crc32(part), part))
                columns = list(zip(*rows, strict=True))[: len(names)]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=names)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in it) of each item: each goes, in the order given, where the sum over gaps g of (open bins with gap
    g) squared becomes smallest; ties to the smallest gap, and to an open bin before a new one."""
    open_by_gap = np.zeros(capacity + 1)
    open_by_gap[0] = -0.5  # a bin that becomes full leaves the sum: (N - 1)^2 - N^2 = 2 * (-0.5 - N + 1)
    hidden = np.full(capacity + 1, -1e18)  # the same where bins are open, else far below
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    place_in = np.empty(len(sizes), np.int64)
    bin_of = np.empty(len(sizes), np.int64)
    n = 0
    for i, s in enumerate(sizes.tolist()):
        gap = capacity
        if s < capacity:
            change = open_by_gap[: capacity - s] - hidden[s:capacity]
            k = int(change.argmin())
            if change[k] < 1e17 and 2 * change[k] + 2 <= 2 * open_by_gap[capacity - s] + 1:
                gap = s + k
        if gap == capacity:
            chosen, n = n, n + 1
        else:
            chosen = bins[gap].pop()
            left = len(bins[gap])
            open_by_gap[gap] = left
            hidden[gap] = left or -1e18
        bin_of[i], place_in[i] = chosen, capacity - gap
        if gap > s:
            rest = gap - s
            bins[rest].append(chosen)
            open_by_gap[rest] = hidden[rest] = len(bins[rest])
    return bin_of, place_in


def pack(pieces: DataFrame, length: int = 4096, per_block: int = PER_BLOCK) -> DataFrame:
    """pieces (doc_id, piece, start, length, ...) with sequence_id and offset.

    Blocks of about per_block pieces, dealt by a hash of (doc_id, piece, start), are packed each by itself, longest first,
    so that no task grows with the input; a block leaves a few sequences unfilled, well under 1 % at the default.
    """
    spark_blocks = blocks_for(pieces.count(), per_block)
    schema = pieces.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ", sequence_id bigint, offset bigint"

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.drop(columns="_block").sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        found, place = sum_of_squares(p["length"].to_numpy(np.int64), length)
        return p.assign(sequence_id=found + (int(key[0]) << 32), offset=place)

    block = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spark_blocks)).cast("long")
    return pieces.withColumn("_block", block).groupBy("_block").applyInPandas(run, schema)


def packed(documents: DataFrame, tokenizer: str, length: int = 4096) -> DataFrame:
    """Tokenise and pack all documents.

    A null or empty text is one piece of the end id alone. A null doc_id is kept as null. Repeated rows are packed each;
    equal lengths go by doc_id. An empty table gives an empty result; extra columns are ignored.
    """
    return pack(materialise(tokenise(documents, tokenizer, length), "pieces"), length)


def sequences(documents: DataFrame, tokenizer: str, length: int = 4096) -> DataFrame:
    """The sequences themselves: sequence_id, ids (array of the ids), doc_ids in order."""
    placed = pack(materialise(tokenise(documents, tokenizer, length, with_ids=True), "pieces"), length)

    def join(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("offset")
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [np.frombuffer(b"".join(p["ids"]), "<u4").astype(np.int64)], "doc_ids": [p["doc_id"].tolist()]})

    return placed.groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids array<long>, doc_ids array<long>")
