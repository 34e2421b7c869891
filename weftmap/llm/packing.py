"""Concatenate and cut: pack token ids into fixed windows.

All documents, each closed by an end id, form one stream.  The first pass tokenises where
the texts are read, writes the ids, and keeps for each document its partition and its start
in that partition.  Partition totals (one row a partition) give every partition its offset in
the stream by a prefix sum; the second pass cuts at multiples of the window and emits a
boundary record for each piece.  No text is shuffled and every window but the last is full.

Defined results
    null or empty text   a document of the end id alone
    very long text       tokenised piece by piece; cut over as many windows as it needs
    other vocabularies   any file of the library; ids take two or four bytes by its size
    repeated rows        each is packed on its own
    empty table          no pieces
    extra columns        not read; ``keep`` names columns that the pieces carry
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import arrow_rows, saved

WINDOW, END_ID = 2048, 1
VOCABULARY_FILE = "word_bpe_49k.json"
#: Words whose ids a Python worker keeps at most; more are looked up again.
CACHE_WORDS = 200_000
#: Characters of a text that are tokenised at once, and rows that go to Python at once.
PIECE_CHARS, BATCH_ROWS = 1 << 20, 1000


def vocabulary_path(name: str = VOCABULARY_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of the ``tokenizers`` library as bytes, with a memory for words.

    The library spends most of its time in normalising and splitting.  Where a vocabulary file has
    the rules ``RULES``, a text of plain characters is split here by one pattern, and each distinct
    lower-case word goes to the library's model once.  Which characters are plain, and which are
    letters, digits or spaces, is asked of the library itself, one by one.  Every other text, and
    every text under other rules, goes through the library whole.
    """

    # The splitting rules of the vocabulary file, under which words can be kept apart.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    STEPS = ["NFC", "Replace", "Lowercase"]
    LAST = 0x250

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.limit = self.whole.model, cache_words
        self.known: dict[str, bytes] = {}
        self.width = "<u2" if max([self.whole.get_vocab_size(), *(k + 1 for k in self.whole.get_added_tokens_decoder())]) <= 1 << 16 else "<u4"
        added = self.whole.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        rules = json.loads(self.whole.to_str())
        steps = [x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.apart = steps == self.STEPS and split == [self.SPLIT, None] and not any(t.normalized or re.search(r"\s", t.content) for t in added)
        if self.apart:
            plain, letters, digits, spaces = self.alphabet()
            self.plain = re.compile(f"[{plain}]*")
            self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{spaces}{letters}{digits}]+")
        # the byte alphabet: printable bytes stand for themselves, the rest follow from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def alphabet(self) -> tuple[str, str, str, str]:
        """Pattern classes: plain characters, and letters, digits and spaces among their lower case."""
        normal = lambda c: self.whole.normalizer.normalize_str(c)
        count = lambda c: len(self.whole.pre_tokenizer.pre_tokenize_str(c))
        kinds: dict[str, list[str]] = {"letter": [], "digit": [], "space": [], "other": []}
        for c in map(chr, range(self.LAST)):
            if count(normal(c)) == 0:
                kinds["space"].append(c)
            elif normal(c) == c:
                kinds["letter" if count("x" + c) == 1 else "digit" if count(c + c) == 2 else "other"].append(c)
        known = set().union(*kinds.values())
        plain = [c for c in map(chr, range(self.LAST)) if c in kinds["space"] or (c.lower() in known and normal(c) == c.lower())]
        return tuple("".join(map(re.escape, x)) for x in (plain, kinds["letter"], kinds["digit"], kinds["space"]))

    def word(self, word: str) -> bytes:
        spelled = word if word.isascii() and word.isprintable() else word.encode("utf-8").decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(spelled)], dtype=self.width).tobytes()

    def library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.width).tobytes()

    def ids(self, text: str) -> bytes:
        """All ids of a text; a long one is taken piece by piece, cut at white space, which no word crosses."""
        if not self.apart:
            return self.library(text)
        if len(text) <= PIECE_CHARS:
            return self.piece(text)
        out, at = [], 0
        while at < len(text):
            end = min(len(text), at + PIECE_CHARS)
            if end < len(text):
                cut = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
                if cut < 0:
                    cut = min((x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0), default=len(text))
                end = min(len(text), cut + 1)
            out.append(self.piece(text[at:end]))
            at = end
        return b"".join(out)

    def piece(self, text: str) -> bytes:
        if not self.plain.fullmatch(text) or any(s in text for s in self.special):
            return self.library(text)
        words = self.split.findall(text.lower())
        found = list(map(self.known.get, words))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = self.known.get(words[k]) or self.learn(words[k])
        return b"".join(found)

    def learn(self, word: str) -> bytes:
        ids = self.word(word)
        if len(self.known) < self.limit:
            self.known[word] = ids
        return ids


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenised(docs: DataFrame, path: str, text: str = "text", keep: Sequence[str] = ("doc_id",), end_id: int = END_ID) -> DataFrame:
    """(keep..., __ids, __tokens, __part, __at): ids of every document, and where it stands in its partition."""
    kept = docs.select(*keep).schema
    schema = T.StructType([*kept, T.StructField("__ids", T.BinaryType()), T.StructField("__tokens", T.LongType()), T.StructField("__part", T.LongType()), T.StructField("__at", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=enc.width).tobytes()
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = [enc.ids(t or "") + end for t in batch.column(batch.num_columns - 1).to_pylist()]
            sizes = np.array([len(x) // len(end) for x in ids], dtype=np.int64)
            starts = at + np.cumsum(sizes) - sizes
            at += int(sizes.sum())
            own = [pa.array(ids, pa.binary()), pa.array(sizes), pa.array(np.full(len(ids), part)), pa.array(starts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *own], names=[*kept.names, "__ids", "__tokens", "__part", "__at"])

    return docs.select(*keep, F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str | None = None, text: str = "text", keep: Sequence[str] = ("doc_id",), window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: keep..., start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    path = path or vocabulary_path()
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        stored = saved(tokenised(docs, path, text, keep, end_id), "tokens")
    totals = stored.groupBy("__part").agg(F.sum("__tokens").alias("__total"))
    before = W.Window.orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)  # one row a partition
    bases = totals.select("__part", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__base"))
    placed = stored.join(F.broadcast(bases), "__part").withColumn("__at", F.col("__at") + F.col("__base"))
    kept = docs.select(*keep).schema
    longs = [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    schema = T.StructType([*kept, *longs, *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.num_columns - 3
            row, start, length, crc, tokens, seq, offset, bodies = [], [], [], [], [], [], [], []
            for r, (ids, at, n) in enumerate(zip(*(batch.column(k + c) for c in range(3)))):
                ids, at, n = np.frombuffer(ids.as_buffer(), np.uint8), at.as_py(), n.as_py()
                ids, done = ids.view(f"<u{len(ids) // n}").astype("<u4"), 0
                while done < n:
                    sequence, inside = divmod(at + done, window)
                    take = min(window - inside, n - done)
                    body = ids[done : done + take].tobytes()
                    row.append(r), start.append(done), length.append(take), crc.append(zlib.crc32(body))
                    tokens.append(n), seq.append(sequence), offset.append(inside)
                    if with_ids:
                        bodies.append(body)
                    done += take
            chosen = pa.RecordBatch.from_arrays(batch.columns[:k], names=kept.names).take(pa.array(row, pa.int64()))
            own = [pa.array(x, pa.int64()) for x in (start, length, crc, tokens, seq, offset)] + ([pa.array(bodies, pa.binary())] if with_ids else [])
            yield pa.RecordBatch.from_arrays([*chosen.columns, *own], names=schema.names)

    return placed.select(*keep, "__ids", "__at", "__tokens").mapInArrow(cut, schema)
