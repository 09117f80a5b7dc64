"""Packing token sequences by minimum bin slack.

Only lengths matter to a packing, and there are at most ``capacity`` of them: their counts are gathered, and on them
each bin takes the longest piece left and, by a bitset subset-sum over the lengths left, the fullest combination
beside it. A combination is taken as often as the counts allow, so the plan has a bounded number of rows however many
pieces there are. Pieces then find their places by their rank within their length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keystrata.llm.shared import small, store

CAPACITY = 2048
#: Ranks within a length are counted over parts of about so many pieces, as one length may be that of very many.
PART_PIECES, LEAST_PARTS = 50_000, 16
#: Words whose ids a worker remembers.
CACHE_WORDS = 250_000
#: Fresh words that are encoded as one text.
FRESH_WORDS = 4000

# The splitting rule of the tokenizer file, and the same rule for Python's re within plain texts.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters for which re's classes, lower() or NFC may differ from the tokenizer's.
_OTHER = re.compile("[^\x00-˿]|[\x1c-\x1f²³¹¼-¾İ]")
_CHARS = sorted({d for c in map(chr, range(0x300)) for d in (c, *c.lower())})


def _class(rule: str) -> str:
    """The characters of plain texts that match a rule, spelled out: far faster than the rule's classes."""
    return "[" + "".join(re.escape(c) for c in _CHARS if re.fullmatch(rule, c)) + "]"


_LETTER, _MARK = _class(r"[^\W\d_]"), _class(r"[^\s\w]|_")
_WORD = re.compile(rf"{_LETTER}+|[0-9]|'(?:s|t|re|ve|m|ll|d)|{_MARK}+")


def plain(text: str) -> bool:
    """Whether a text holds none of _OTHER; texts of small characters are searched for the few that it names."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return not _OTHER.search(text)
        if any(c in text for c in "²³¹¼½¾"):
            return False
    return not any(c in text for c in "\x1c\x1d\x1e\x1f")


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    A tokenizer that only lower-cases and splits by ``_SPLIT`` treats each word alone, so a word's ids are looked up
    once and remembered. Fresh words are encoded as one text, cut where an id ends a word by the model's suffix; other tokenizers, and texts that hold one of ``_OTHER`` or an added token of the file (whose
    own id it gets, as the library's encode() has it), take the library's path.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            text = file.read()
        self.tokenizer = Tokenizer.from_str(text)
        spec = json.loads(text)
        added = [x["content"] for x in spec.get("added_tokens") or [] if x["content"]]
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE)
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [x.get("pattern", {}).get("Regex") for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and split == [_SPLIT, None]
        self.cache: dict[str, bytes] = {}
        model = spec.get("model") or {}
        vocab, suffix = model.get("vocab"), model.get("end_of_word_suffix")
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        if isinstance(vocab, dict) and suffix:
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix) and i < len(self.ends)]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _coded(self, words: list[str]) -> list[bytes]:
        """Each word's ids."""
        ids = np.frombuffer(self._library([" ".join(words)])[0], "<u4")
        at = np.flatnonzero(self.ends[ids]) + 1
        if len(at) != len(words) or at[-1:].tolist() != [len(ids)][: len(at)]:
            return self._library(words)
        blob, at = ids.tobytes(), [0, *(4 * at).tolist()]
        return [blob[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        words = [_WORD.findall(t.lower()) if self.by_word and plain(t) and not self.added.search(t) else None for t in texts]
        held = set().union(*(ws for ws in words if ws))
        fresh = list(held.difference(self.cache))
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self.cache = {}
            fresh = list(held)
        for a in range(0, len(fresh), FRESH_WORDS):
            part = fresh[a : a + FRESH_WORDS]
            self.cache.update(zip(part, self._coded(part), strict=True))
        get = self.cache.__getitem__
        for text, ws in zip(texts, words, strict=True):
            yield self._library([text])[0] if ws is None else b"".join(map(get, ws))


@lru_cache(1)
def encoder(path: str) -> Encoder:
    """One encoder for a worker, across its tasks."""
    return Encoder(path)


def _slices(texts: list[str], limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held > limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; with_ids adds the ids (unsigned 32-bit, little-endian).

    A document is its text's ids and then end_id; null texts count as empty. Only documents of more than capacity ids
    are cut. Rows with a null or repeated doc_id are documents of their own.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.binary()] if with_ids else [])]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, last = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        for batch in small(batches):
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            for a, b in _slices(texts):
                out = []
                for doc, coded in zip(ids[a:b], coder.encode(texts[a:b]), strict=True):
                    coded += last
                    for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                        part = coded[at : at + 4 * capacity]
                        out.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(apply, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids)


def fullest(counts: dict[int, int], room: int, slack: int = 0) -> dict[int, int]:
    """How many of each length fill ``room`` as far as any combination of them can, or but for ``slack``.

    Long lengths come first, and shorter ones only as far as they are needed: they fit in later more easily.
    """
    reach, steps = 1, []
    mask = (1 << room + 1) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        steps.append((length, reach))
        left, step = min(counts[length], room // length), 1
        while left:
            take = min(step, left)
            reach |= reach << take * length & mask
            left, step = left - take, step * 2
        if reach >> max(0, room - slack):
            break
    at, out = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        k = 0
        while not before >> at - k * length & 1:
            k += 1
        if k:
            out[length] = k
            at -= k * length
    return out


#: Slacks that a plan may leave in a bin before it looks for a fuller combination; the plan of fewest bins is taken.
SLACKS = (0, 4, 16, 64)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces in a bin, first bin, offset in the bin), by length and rank.

    Each bin holds the longest length left and the fullest combination beside it.
    """
    least, found = -(-sum(k * v for k, v in counts.items()) // capacity), []
    for slack in SLACKS:
        if slack < capacity and not (found and min(found, key=lambda x: x[0])[0] == least):
            found.append(_plan(counts, capacity, slack))
    return min(found, key=lambda x: x[0])[1]


def _plan(counts: dict[int, int], capacity: int, slack: int) -> tuple[int, np.ndarray]:
    left, used, base, rows = {k: v for k, v in counts.items() if v}, dict.fromkeys(counts, 0), 0, []
    while left:
        top = max(left)
        left[top] -= 1
        bin_ = fullest({k: v for k, v in left.items() if v}, capacity - top, slack)
        left[top] += 1
        bin_[top] = bin_.get(top, 0) + 1
        times, offset = min(left[k] // n for k, n in bin_.items()), 0
        for k in sorted(bin_, reverse=True):
            rows.append((k, used[k], bin_[k], base, offset))
            offset += k * bin_[k]
            used[k] += times * bin_[k]
            left[k] -= times * bin_[k]
            if not left[k]:
                del left[k]
        base += times
    return base, np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset; cut: stored rows with doc_id, piece, length and ids_crc32, none over capacity.

    Sequences of one full piece have negative numbers.
    """
    spark = cut.sparkSession
    counts = {r.length: r["count"] for r in cut.groupBy("length").count().collect()}
    # A piece that fills a sequence needs no plan and no rank.
    full = cut.where(F.col("length") == capacity).select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    full = full.withColumn("sequence_id", -1 - F.col("sequence_id"))
    cut, counts = cut.where(F.col("length") < capacity), {k: v for k, v in counts.items() if k < capacity}
    salts = max(LEAST_PARTS, max(counts.values(), default=0) // PART_PIECES)
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    parts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    table = spark.sparkContext.broadcast(plan(counts, capacity))
    before = parts.select("length", "_salt", (F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("_within", within - 1).join(before, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_within")).select(*cut.columns, "_rank")
    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for batch in small(batches):
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            _, first, each, base, offset = rows[np.searchsorted(keys, length << 44 | rank, "right") - 1].T
            nth = rank - first
            more = [pa.array(base + nth // each), pa.array(offset + nth % each * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema).unionByName(full)


def pack_documents(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """All pieces of all documents with their sequence and place; see ``pieces`` and ``pack``."""
    cut, _ = store(pieces(documents, tokenizer, capacity, with_ids=with_ids), "pieces")
    return pack(cut, capacity)
