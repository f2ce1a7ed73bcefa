"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces whose lengths are powers of two, the binary digits of
its length (2048 as often as it goes).  Every piece is a sequence of its own, equal lengths share
a bucket, and so no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import KEPT, give_back, parts, small_batches, text_or_empty

LENGTH = 2048
END = 1


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself where that prints, else the next from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: The rules of a tokenizer file under which texts may be cut at spaces and words of
#: Latin-1 letters handed to the model.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def cuts_at_spaces(path: str) -> bool:
    """Whether a tokenizer file has the rules that Words relies on; special tokens have no spaces."""
    import json

    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    special = [t["content"] for t in found.get("added_tokens") or []]
    return all(found.get(k) == v for k, v in RULES.items()) and found["model"]["type"] == "BPE" and not any(c.isspace() for t in special for c in t) and not any(t.get("lstrip") or t.get("rstrip") for t in found.get("added_tokens") or [])


class Words:
    """Token ids of whole texts through a table of the chunks between spaces.

    A tokenizer file with other rules than RULES takes the plain way, whole texts at a time.

    A literal special token in a text gets that token's id, as the tokenizer by itself gives it.
    The tokenizer drops white space and no rule of it reaches across a space, so a text's ids are
    those of its chunks, one after another.  Most chunks are a word of Latin-1 letters, maybe with a
    full stop or comma, which the tokenizer cuts off: such a word goes straight to the tokenizer's
    model, once for all its spellings, which share a row of ids.  Others take the tokenizer's whole
    way.  The table starts anew when its entries take about ``room`` bytes.
    """

    def __init__(self, path: str, room: int = 160 << 20) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.by_chunk = Tokenizer.from_file(path), cuts_at_spaces(path)
        self.model, self.letters, self.room = self.tokenizer.model, _byte_letters(), room
        self.marks = {m: self.tokenizer.encode(m, add_special_tokens=False).ids for m in ".,"}
        self.clear()

    def clear(self) -> None:
        #: Rows of ids by chunk and by word in lower case.
        self.index: dict[str, int] = {}
        self.words: dict[str, int] = {}
        #: Row 0 is the mark of a document's end.
        self.pool, self.start, self.length = np.array([END], np.uint32), np.zeros(1, np.int64), np.ones(1, np.int64)
        self.held = 0

    def _ids(self, word: str) -> list[int]:
        text = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(text)]

    def learn(self, chunks: list[str]) -> None:
        base, found = len(self.start), []
        rest: list[str] = []
        for chunk in chunks:
            stem = chunk[:-1] if chunk[-1:] in self.marks else chunk
            if not stem.isalpha() or not (stem.isascii() or max(stem) < "\u0100"):
                rest.append(chunk)
                continue
            word = stem.lower()
            row = self.words.get(word)
            if row is None:
                row = self.words[chunk if word == chunk else word] = base + len(found)
                found.append(self._ids(word))
                self.held += len(word) + 150
            if stem is not chunk:
                ids = found[row - base] if row >= base else self.pool[self.start[row] : self.start[row] + self.length[row]].tolist()
                row = base + len(found)
                found.append(ids + self.marks[chunk[-1]])
            self.index[chunk] = row
        for chunk, x in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            self.index[chunk] = base + len(found)
            found.append(x.ids)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.start = np.r_[self.start, len(self.pool) + np.cumsum(lengths) - lengths]
        self.length = np.r_[self.length, lengths]
        self.pool = np.r_[self.pool, np.array([i for ids in found for i in ids], np.uint32)]
        self.held += sum(map(len, chunks)) + 170 * len(chunks) + 16 * len(found) + 4 * int(lengths.sum())

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings, none null), each with END behind it, and the bounds of each."""
        if not self.by_chunk:
            found = [np.array([*x.ids, END], np.uint32) for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.uint32), *found]), np.cumsum([0, *map(len, found)])
        if self.held > self.room:
            self.clear()
        for space in "\n\t":
            texts = pc.replace_substring(texts, space, " ")
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        self.learn([c for c in chunks if c not in self.index])
        table = np.fromiter(map(self.index.__getitem__, chunks), np.int64, len(chunks))
        ends = split.offsets.to_numpy()[1:] - split.offsets.to_numpy()[0]
        at = np.insert(table[coded.indices.to_numpy()], ends, 0)
        lengths = self.length[at]
        upto = np.cumsum(lengths)
        total = int(upto[-1]) if len(upto) else 0
        ids = self.pool[np.repeat(self.start[at] - (upto - lengths), lengths) + np.arange(total)]
        return ids, np.r_[0, upto[ends + np.arange(len(ends))]]


def kept_words(path: str) -> Words:
    """The table of this worker process, which its later tasks find filled."""
    import sys
    import types

    home = sys.modules.setdefault(KEPT, types.ModuleType(KEPT)).__dict__
    if ("words", path) not in home:
        home["words", path] = Words(path)
    return home["words", path]


def pieces(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids, longest first."""
    out = [(i * length, length) for i in range(n // length)]
    at, size = n - n % length, length // 2
    while size:
        if n & size:
            out.append((at, size))
            at += size
        size //= 2
    return out


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, chars: int = 4_000_000) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, bucket, sequence_id, offset), a row for each piece.

    ids: the piece's ids, little-endian unsigned 32-bit.  bucket: the logarithm of the length;
    sequence_id has it in its top bits and counts rows below, so that buckets are ranges of it.
    ``length`` must be a power of two.  A null text counts as empty, whose only id is END.
    Repeated rows and rows without doc_id are packed like others.  Batches of about ``chars`` bytes
    bound memory, not results.  An empty table gives an empty result; other columns are ignored.
    """
    if length & (length - 1) or length < 1:
        raise ValueError("length must be a power of two")
    small_batches(docs.sparkSession, 1000)

    def batch(docs: pa.Array, texts: pa.Array, words: Words) -> pa.RecordBatch:
        ids, bounds = words.encode(texts)
        raw = memoryview(ids.astype("<u4").tobytes())
        cols: list[list] = [[], [], [], [], []]
        for doc, a, b in zip(docs.to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            for start, size in pieces(b - a, length):
                for col, x in zip(cols, (doc, start, size, bytes(raw[4 * (a + start) : 4 * (a + start + size)]), b - a), strict=True):
                    col.append(x)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = kept_words(tokenizer)
        for got in batches:
            ends = np.cumsum(pc.binary_length(got.column(1)).to_numpy())
            at = 0
            while at < got.num_rows:
                before = int(ends[at - 1]) if at else 0
                n = max(1, int(np.searchsorted(ends, before + chars, "right")) - at)
                yield batch(got.column(0).slice(at, n), got.column(1).slice(at, n), words)
                at += n
        give_back(kept=False)

    rows = parts(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long")
    bucket = F.log2("length").cast("int")
    return rows.withColumn("bucket", bucket).withColumn("sequence_id", F.shiftleft(F.col("bucket").cast("long"), 58) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Writes packed pieces in a folder for each bucket, bucket=0 to bucket=11 at a length of 2048, so
    that a reader of one bucket gets sequences of one length.  Nothing is shuffled."""
    packed.write.partitionBy("bucket").parquet(path)
