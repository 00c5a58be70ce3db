"""Token ids of documents in files of independently decodable rANS blocks."""

from __future__ import annotations

import gc
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .common import stored, utf8

BLOCK_IDS = 1 << 17
FILE_IDS = 1 << 24
END_ID = 1
CACHED_WORDS = 450_000
_MARK = "\x01"
_SPLIT = 2_000
_PART = 4 << 20
# ASCII signs between a letter and white space are a piece of their own, so they can stand apart as a word.
_SIGNS = re.compile(rb"(?<=[a-z])([!-&(-/:-@\[-`{-~]+)(?=\s|$)")
_tokenizers: dict[str, "WordTokenizer"] = {}


class WordTokenizer:
    """A tokenizer of the `tokenizers` library that never joins text across ASCII white space (lower-casing word BPE).

    Words between white space are encoded once and kept. A full store of CACHED_WORDS words becomes the older one, from
    which words in use return, so memory is bounded whatever the vocabulary of the corpus; ids do not depend on it.
    Signs at the end of a word are set apart before, so `word,` is no new word. A word of ASCII letters is one piece for
    the model itself; others go through the whole tokenizer, many at a time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.mark = self._ids(_MARK)
        self.letters = self._checked()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _learn(self, words: Iterable[bytes]) -> None:
        plain = []
        pieces = self.tokenizer.model.tokenize
        for w in words:
            if w in self.older:
                self.known[w] = self.older[w]
            elif self.letters and w.isalpha() and w.isascii():
                self.known[w] = array(self.code, [x.id for x in pieces(w.decode())]).tobytes()
            elif _MARK.encode() in w or len(self.mark) != 1:
                self.known[w] = self._ids(w.decode("utf-8", "replace")).tobytes()
            else:
                plain.append(w)
        width = self.kind.itemsize
        for at in range(0, len(plain), _SPLIT):
            part = plain[at : at + _SPLIT]
            ids = self._ids(f" {_MARK} ".join([w.decode("utf-8", "replace") for w in part]))
            ends = [*np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)]
            data, first = ids.tobytes(), 0
            for w, end in zip(part, ends, strict=True):
                self.known[w] = data[first * width : end * width]
                first = end + 1

    def _checked(self) -> bool:
        """True if letters reach the model as they are; an error if words do not stand for themselves in a text."""
        words = ["one", "wordlike", "it's", "x9", "naïve"]
        apart = np.concatenate([self._ids(w) for w in words])
        if not all(np.array_equal(self._ids(t), apart) for t in (" ".join(words), "\n ".join(words).upper(), "\t".join(words))):
            raise ValueError("The tokenizer joins text across white space or tells upper from lower case.")
        if not np.array_equal(self._ids("word,;\nword."), self._ids("word ,;\nword .")):
            raise ValueError("The tokenizer does not set signs apart from letters.")
        return all([x.id for x in self.tokenizer.model.tokenize(w)] == self._ids(w).tolist() for w in ("one", "wordlike", "qzxjv"))

    def encode(self, texts: list[bytes], end: int) -> list[bytes]:
        """Little-endian ids of each text, with the end id."""
        out: list[bytes] = []
        part: list[bytes] = []
        size = 0
        for text in texts:
            part.append(text)
            size += len(text)
            if size > _PART:
                out += self._encode_part(part)
                part, size = [], 0
        last = np.array([end], self.kind).tobytes()
        return [ids + last for ids in out + self._encode_part(part)]

    def encode_quietly(self, texts: list[bytes], end: int) -> list[bytes]:
        """`encode` without cyclic garbage collection, which walks the millions of words held here and finds nothing."""
        gc.disable()
        try:
            return self.encode(texts, end)
        finally:
            gc.enable()

    def _encode_part(self, texts: list[bytes]) -> list[bytes]:
        # A text that may hold the name of a special token, which is case-sensitive, is encoded as it is.
        words = [_SIGNS.sub(rb" \1", text.lower()).split() if b"<|" not in text else [] for text in texts]
        found = [list(map(self.known.get, w)) for w in words]
        open_texts = [i for i, ids in enumerate(found) if None in ids]
        new: set[bytes] = set()
        for i in open_texts:
            new.update([w for w, ids in zip(words[i], found[i]) if ids is None])
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        self._learn(new)
        known = self.known
        for i in open_texts:
            found[i] = [known[w] if ids is None else ids for w, ids in zip(words[i], found[i])]
        return [
            self._ids(text.decode("utf-8", "replace")).tobytes() if b"<|" in text else b"".join(ids)
            for text, ids in zip(texts, found)
        ]


def _tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def _ids(path: str, end: int) -> Callable[[pa.Array], pa.Array]:
    def ids(texts: pa.Array) -> pa.Array:
        from zstandard import ZstdCompressor

        pack = ZstdCompressor(level=1).compress
        return pa.array([pack(x) for x in _tokenizer(path).encode_quietly([t or b"" for t in texts.to_pylist()], end)], pa.binary())

    return ids


def _unpacked(column: pa.Array, kind: str) -> list[np.ndarray]:
    from zstandard import ZstdDecompressor

    unpack = ZstdDecompressor().decompress
    return [np.frombuffer(unpack(x), kind) for x in column.to_pylist()]


def _counts(kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for part in parts:
            for ids in _unpacked(part.column("ids"), kind):
                new = np.bincount(ids, minlength=len(total))
                new[: len(total)] += total
                total = new
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return count


BLOCK = (
    "file int, block int, first bigint, doc_ids array<bigint>, sizes array<int>, n int, places array<int>, "
    "states binary, words binary, crc bigint"
)
_BLOCK = pa.schema(
    [
        ("file", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())), ("n", pa.int32()), ("places", pa.list_(pa.int32())), ("states", pa.binary()),
        ("words", pa.binary()), ("crc", pa.int64()),
    ]
)


def _blocks(shared, kind: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def blocks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = rans.Table(*shared.value)
        file, block, first = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            coded = rans.encode(np.concatenate(held), table)
            row = {"file": file, "block": block, "first": first, "doc_ids": docs, "sizes": [len(x) for x in held]}
            return pa.RecordBatch.from_pylist([row | coded], _BLOCK)

        for part in parts:
            for doc, ids in zip(part.column("doc_id").to_pylist(), _unpacked(part.column("ids"), kind)):
                docs.append(doc)
                held.append(ids)
                size += len(ids)
                if size >= BLOCK_IDS:
                    yield flush()
                    block, first = block + 1, first + size
                    docs, held, size = [], [], 0
        if held:
            yield flush()

    return blocks


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Write the token ids of all documents, each with `end_id` after it, below `path` in ascending doc_id order.

    `path`/table: id, n (the shared frequencies, one row per id that occurs). `path`/blocks: one row per rANS block, in
    files by ranges of doc_id. A block holds whole documents, BLOCK_IDS ids or as many more as its last document has.

    Null texts are empty: the end id alone. Null ids come first. Rows that repeat an id follow each other. An empty
    table gives files without rows. Other columns are not written.
    """
    spark = docs.sparkSession
    kind = _tokenizer(tokenizer).kind.str
    ids = F.arrow_udf(_ids(tokenizer, end_id), "binary")
    made = stored(docs.select("doc_id", ids(utf8("text")).alias("ids")), "tokens")
    counts = made.select("ids").mapInArrow(_counts(kind), "id bigint, n bigint")
    counts.groupBy("id").agg(F.sum("n").alias("n")).write.parquet(f"{path}/table")
    shared = _frequencies(spark, path)
    files = max(1, -(-int(shared.value[1].sum()) // FILE_IDS))
    mix = F.crc32("ids")
    ordered = (
        made.select("doc_id", mix.alias("mix"), "ids")
        .repartitionByRange(files, "doc_id", "mix")
        .sortWithinPartitions("doc_id", "mix")
    )
    ordered.select("doc_id", "ids").mapInArrow(_blocks(shared, kind), BLOCK).write.parquet(f"{path}/blocks")


def _facts(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def facts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.Table(*shared.value)
        for part in parts:
            for row in part.to_pylist():
                data = memoryview(rans.decode(row, table).astype("<u4").tobytes())
                ends = np.cumsum(row["sizes"])
                starts = ends - row["sizes"]
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["file"]] * len(sums), pa.int32()), pa.array(row["doc_ids"], pa.int64()),
                        pa.array(row["first"] + starts, pa.int64()), pa.array(row["sizes"], pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["file", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    return facts


def _frequencies(spark: SparkSession, path: str):
    """The shared table, broadcast: as many rows as the vocabulary has ids at most."""
    rows = sorted(spark.read.schema("id bigint, n bigint").parquet(f"{path}/table").collect())
    ids, counts = (np.array(c, np.int64) for c in (zip(*rows) if rows else ((), ())))
    return spark.sparkContext.broadcast((ids, counts))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 of every document."""
    blocks = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file: a few bytes for every FILE_IDS ids.
    files = blocks.groupBy("file").agg(F.sum("n").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    facts = blocks.mapInArrow(
        _facts(_frequencies(spark, path)), "file int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return facts.join(files, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
