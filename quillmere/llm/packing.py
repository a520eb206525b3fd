"""Packing token sequences: first-fit decreasing over a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.shared import lean, ready

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_SPACE = re.compile(r"[ \n\t\r]")
#: Distinct words that a worker remembers; the rest is encoded again.
WORDS = 700_000
#: Texts whose words this module cuts as the tokenizer does: printable ASCII and the Latin letters after it, between white
#: space. Other texts go through the tokenizer word by word.
_EASY = re.compile(r"[ \n\t\r!-~\u00c0-\u012f\u0132-\u024f]*")
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")


def byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    free = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(free)) for b in range(256)}


class WordEncoder:
    """Ids of a text as little-endian 32-bit bytes.

    No token crosses white space or the border of a run of letters, so words and their parts are encoded once and kept.
    """

    def __init__(self, path: str, words: int = WORDS):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.signs = self.tokenizer.model, byte_signs()
        self.parts, self.odd, self.room = {"": b""}, {"": b""}, words
        self.as_expected = self._as_expected(path)

    @staticmethod
    def _as_expected(path: str) -> bool:
        """Whether the file's rules are the ones _PART stands for; else every word goes through the tokenizer itself."""
        import json

        with open(path) as f:
            rules = json.load(f)
        split = (rules.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        lower = [n.get("type") for n in (rules.get("normalizer") or {}).get("normalizers", [])]
        return lower == ["NFC", "Replace", "Lowercase"] and len(split) == 2 and split[0].get("pattern", {}).get("Regex") == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and split[1].get("type") == "ByteLevel"

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            written = part if part.isascii() else "".join(map(self.signs.__getitem__, part.encode()))
            ids = _packed([t.id for t in self.model.tokenize(written)])
            if len(self.parts) < self.room:
                self.parts[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of a word in small letters."""
        if word.isalpha():
            return self._part(word)
        if word[-1] in ",." and word[:-1].isalpha():
            return self._part(word[:-1]) + self._part(word[-1])
        return b"".join(map(self._part, _PART.findall(word)))

    def _odd_word(self, word: str) -> bytes:
        ids = self.odd.get(word)
        if ids is None:
            ids = _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
            if len(self.odd) < self.room // 4:
                self.odd[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(self._encode(slices(text))) if len(text) > SLICE else b"".join(self._encode([text])) for text in texts]

    def _encode(self, parts) -> list[bytes]:
        out = []
        for text in parts:
            easy = self.as_expected and "<|" not in text and _EASY.fullmatch(text)
            known, other = (self.parts, self._word) if easy else (self.odd, self._odd_word)
            get = known.get
            words = (text.lower() if easy else text).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            got = list(map(get, words))
            if None in got:
                got = [other(w) if g is None else g for w, g in zip(words, got)]
            out.append(b"".join(got))
        return out


#: Characters of a text that are handled together.
SLICE = 1 << 20


def slices(text: str):
    """The text in parts of about SLICE characters that start at white space, which no token crosses."""
    at = 0
    while len(text) - at > SLICE:
        m = _SPACE.search(text, at + SLICE)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def cut(ids: bytes, size: int) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of full pieces and what is left."""
    view = memoryview(ids)
    return [(at // 4, min(size, (len(ids) - at) // 4), zlib.crc32(view[at : at + 4 * size])) for at in range(0, len(ids), 4 * size)]


class Tournament:
    """Bins in the order of opening; each inner node holds the larger capacity below, so the first bin that fits is a walk down."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1 << max(0, (most - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)
        self.capacity = capacity

    def place(self, length: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < length:
                at += 1
        offset = self.capacity - best[at]
        best[at] -= length
        leaf = at - self.leaves
        while at > 1:
            at //= 2
            best[at] = max(best[2 * at], best[2 * at + 1])
        return leaf, offset


def pack_group(pdf: pd.DataFrame, size: int) -> pd.DataFrame:
    """First-fit decreasing over one group; ties go by document, start and checksum."""
    pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", na_position="first").reset_index(drop=True)
    full = int((pdf["length"] == size).sum())
    lengths = pdf["length"].tolist()
    tree = Tournament(size, max(1, len(lengths) - full))
    placed = [(i, 0) for i in range(full)] + [(full + b, o) for b, o in map(tree.place, lengths[full:])]
    first = (pdf["pack_group"].to_numpy(dtype="int64")) << np.int64(32)
    return pdf.drop(columns="pack_group").assign(sequence_id=first + np.array([b for b, _ in placed], dtype="int64"), offset=np.array([o for _, o in placed], dtype="int64"))


def token_pieces(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, size: int = 2048, end: int = 1) -> DataFrame:
    """Each document's ids with the end id, cut at multiples of size: doc_id, start, length, ids_crc32, doc_tokens.

    row_key tells rows apart: a hash of doc_id, the ids, the part of the input they stand in and, among rows of that part
    that are equal, their number. It does not hang on the order of rows, so a task that runs again gives the same keys.
    """
    ready(spark)
    path, tail = tokenizer or default_tokenizer(), np.array([end], dtype="<u4").tobytes()

    @lean
    def run(batches):
        from pyspark import TaskContext

        encoder, context, seen = WordEncoder(path), TaskContext.get(), {}
        part_of = context.partitionId() if context else 0
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            texts = batch.column(1)
            while at < len(ids):
                part, to, chars = [], at, 0
                while to < len(ids) and (chars < 4_000_000 or to == at):
                    part.append(texts[to].as_py() or "")
                    chars += len(part[-1])
                    to += 1
                rows = []
                for doc, got in zip(ids[at:to], encoder.encode(part)):
                    got += tail
                    row = zlib.crc32(got), len(got), doc
                    nth = seen[row] = seen.get(row, 0) + 1
                    key = int.from_bytes(hashlib.blake2b(repr((row, part_of, nth)).encode(), digest_size=8).digest(), "little", signed=True)
                    rows += [(doc, s, n, c, len(got) // 4, key) for s, n, c in cut(got, size)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row_key"])
                at = to

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES + ", row_key long")


def pack(spark: SparkSession, docs: DataFrame, size: int = 2048, group_docs: int = 8192, tokenizer: str | None = None, end: int = 1, seed: int = 11) -> DataFrame:
    """One row per piece with its sequence and offset.

    Only pieces' lengths are shuffled. Groups are dealt by a hash of the row, so each holds about group_docs documents with
    all their pieces, whatever their sources, ids or copies; sequence_id is the group times 2**32 plus the bin.
    A null text is empty and is its end id alone; a null doc_id stays null; repeated rows are packed each, in groups of
    their own; a very long text is encoded in slices and fills sequences of its own but for its last piece; an empty table
    gives no pieces; other columns are ignored. Ties in length go by document, start and checksum.
    """
    pieces = token_pieces(spark, docs, tokenizer, size, end)
    groups = max(1, math.ceil(docs.count() / group_docs))
    dealt = pieces.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(seed), "row_key"), F.lit(groups))).drop("row_key")
    return dealt.groupBy("pack_group").applyInPandas(lambda pdf: pack_group(pdf, size), PIECES + ", sequence_id long, offset long")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of `documents` in sequences of 2048."""
    return pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
