"""Token files: texts as ids of a public tokenizer, coded in blocks in ascending document order.

A file set is three tables: ``table`` (one row: the shared symbol frequencies), ``blocks`` (coded
blocks of whole documents with their ids, lengths and place in the whole sequence) and, while
writing, the packed ids of each document, from which the frequencies and the order are made.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from streamlake.llm import rans
from streamlake.llm.common import fetched, keep_table
from streamlake.session import run_dir

END_ID = 1
BLOCK_TOKENS = 1 << 20
CACHED_PIECES = 1_000_000  # distinct pieces of text a worker holds the ids of

BLOCK_SCHEMA = ("file_part int, block int, doc_ids array<bigint>, "
                "doc_tokens array<bigint>, n_tokens bigint, coded binary")
PACKED_NAMES = ["doc_id", "n_tokens", "ids", "kind", "counts"]
BLOCK_ARROW = pa.schema([
    ("file_part", pa.int32()), ("block", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
    ("n_tokens", pa.int64()), ("coded", pa.binary())])


# Fixed value: how the tokenizer splits lower-cased text, for the letters, digits and signs below U+0100
# that it treats as this says. Apostrophe endings come first, digits stand alone.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00ff"
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+")
_OTHER = re.compile("[^\t\n\r -~\u00c0-\u00ff]")  # anything that rule does not speak of
_NOT_A_SPACE = re.compile("[\x1c-\x1f]")  # white space to Python, but not to the tokenizer
_ASCII_SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def pieces(text: str | None) -> list[str]:
    """Strings whose ids, one after the other, are those of the text.

    The tokenizer drops white space, never joins across it, and codes each piece of its splitting
    rule by itself. Text of plain characters is split here by that rule; of other text, each word
    with an unusual character stays whole, for the tokenizer to split.
    """
    if not text:
        return []
    if not _OTHER.search(text) and "<|" not in text:
        return _PIECE.findall(text.lower())
    words = _ASCII_SPACED.findall(text) if _NOT_A_SPACE.search(text) else text.split()
    return [p for w in words
            for p in ((w,) if _OTHER.search(w) or "<|" in w else _PIECE.findall(w.lower()))]


class PieceEncoder:
    """Ids of whole texts by way of their pieces; each distinct piece is given to the tokenizer once
    for as long as it is held."""

    def __init__(self, path: str, cached_pieces: int = CACHED_PIECES):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.cached_pieces = cached_pieces
        # How the model sees characters: by their bytes, as printable signs.
        signs = ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = str.maketrans({c: signs.pre_tokenize_str(c)[0][0]
                                    for c in map(chr, range(33, 256)) if not _OTHER.match(c)})
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)  # the ids of all entries, one after the other
        self.ends = np.zeros(1 << 14, np.int64)  # where each entry ends; entry 0 is empty
        self.entries = 1

    def _ids(self, piece: str) -> list[int]:
        if _OTHER.search(piece) or "<|" in piece:
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        return [token.id for token in self.model.tokenize(piece.translate(self.signs))]

    def _learn(self, new: list[str]) -> None:
        """Store the ids of pieces that are not held yet."""
        ids = list(map(self._ids, new))
        ends = self.ends[self.entries - 1] + np.cumsum(list(map(len, ids)))
        upto = self.entries + len(new)
        while len(self.ends) < upto:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.ends[self.entries - 1]:ends[-1]] = list(chain.from_iterable(ids))
        self.ends[self.entries:upto] = ends
        self.index.update(zip(new, range(self.entries, upto), strict=True))
        self.entries = upto

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, without special tokens. A null text has none."""
        if len(self.index) > self.cached_pieces:
            self.reset()
        split = [pieces(t) for t in texts]
        named = list(chain.from_iterable(split))
        numbers = list(map(self.index.get, named))
        if None in numbers:
            self._learn(list({p for p, n in zip(named, numbers, strict=True) if n is None}))
            numbers = [self.index[p] if n is None else n
                       for p, n in zip(named, numbers, strict=True)]
        entries = np.array(numbers, dtype=np.int64)
        begins = self.ends[entries - 1]
        each = self.ends[entries] - begins
        upto = np.concatenate([[0], np.cumsum(each)])
        ids = self.flat[np.repeat(begins - upto[:-1], each) + np.arange(upto[-1])]
        ends = upto[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_ENCODERS: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, cached_pieces: int = CACHED_PIECES) -> PieceEncoder:
    """One encoder per Python worker: later tasks find the pieces of earlier ones."""
    key = (path, cached_pieces)
    if key not in _ENCODERS:
        _ENCODERS[key] = PieceEncoder(path, cached_pieces)
    return _ENCODERS[key]


def _portions(texts: list[str | None], most: int = 1 << 20) -> Iterator[list[str | None]]:
    """Runs of texts of about a million characters, so that working arrays stay small."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def packed_kind(vocabulary: int, end_id: int | None) -> str:
    """The integers ids are packed as: 16 bits where all fit."""
    return "<u2" if max(vocabulary - 1, end_id or 0) < 1 << 16 else "<u4"


def pack(docs: DataFrame, path: str, end_id: int | None = END_ID) -> DataFrame:
    """``doc_id, n_tokens, ids, kind, counts``: the packed ids of each text, followed by ``end_id``,
    and, in one more row for each task (all else null), how often each id occurs there. A null text
    counts as empty; a null id stays null."""
    def packed(batches):
        gc.disable()  # lists of many strings, but no cycles
        try:
            yield from _packed(batches)
        finally:
            gc.enable()

    def _packed(batches):
        coder = encoder(path)
        kind = packed_kind(coder.vocabulary, end_id)
        end = np.array([] if end_id is None else [end_id], dtype=kind)
        total = np.zeros(max(coder.vocabulary, (end_id or 0) + 1), np.int64)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            done = 0
            for portion in _portions(texts):
                rows = coder.encode(portion)
                total += np.bincount(np.concatenate(rows), minlength=len(total))
                total[end] += len(rows)
                cells = [r.astype(kind).tobytes() + end.tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(done, len(rows)),
                     pa.array([len(r) + len(end) for r in rows], pa.int64()),
                     pa.array(cells, pa.binary()), pa.array([kind] * len(rows)),
                     pa.nulls(len(rows), pa.binary())], PACKED_NAMES)
                done += len(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()),
             pa.nulls(1, pa.string()), pa.array([total.astype("<i8").tobytes()], pa.binary())],
            PACKED_NAMES)

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        packed, "doc_id bigint, n_tokens bigint, ids binary, kind string, counts binary"))


def symbol_counts(packed: DataFrame) -> DataFrame:
    """``symbol, n``: occurrences of each id, from the sums of the tasks."""
    def unpacked(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                own = np.frombuffer(cell.as_buffer(), "<i8").copy()
                total = own + total if len(total) else own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])],
                                         ["symbol", "n"])

    return (packed.where("counts IS NOT NULL").select("counts")
            .mapInArrow(unpacked, "symbol bigint, n bigint")
            .groupBy("symbol").agg(F.sum("n").alias("n")))


def write(docs: DataFrame, tokenizer_path: str, end_id: int | None = END_ID,
          block_tokens: int = BLOCK_TOKENS) -> str:
    """Write the token files of ``docs (doc_id, text)`` and return their folder.

    Documents stand in ascending id order, null ids first, equal ids by length and content; repeated
    rows are all written. A null or empty text is its end id alone. An empty table gives no block.
    Other columns are ignored. A block holds whole documents, at least ``block_tokens`` ids but for
    the last of a range; a block's neighbours are not needed to decode it.

    The corpus is tokenized once. What is collected is a count for each id of the vocabulary.
    """
    spark = docs.sparkSession
    packed = keep_table(pack(docs, tokenizer_path, end_id), "tokens-packed")
    counts = fetched(symbol_counts(packed).orderBy("symbol"))
    symbols = counts["symbol"].to_numpy(dtype=np.uint32)
    freq = rans.scaled(counts["n"].to_numpy())
    out = run_dir(spark, "tokens")
    spark.createDataFrame(
        [(rans.SCALE_BITS, symbols.tolist(), freq.tolist())],
        "scale_bits int, symbols array<bigint>, frequencies array<bigint>").coalesce(
        1).write.parquet(f"{out}/table")

    def coded(batches):
        from pyspark import TaskContext

        table = rans.Table(symbols, freq)
        part, block = TaskContext.get().partitionId(), 0
        ids, cells, size = [], [], 0

        def row():
            flat = np.concatenate(cells)
            return pa.RecordBatch.from_pylist(
                [{"file_part": part, "block": block, "doc_ids": list(ids),
                  "doc_tokens": [len(c) for c in cells], "n_tokens": len(flat),
                  "coded": rans.encode(flat, table)}], schema=BLOCK_ARROW)

        for batch in batches:
            for doc_id, cell, kind in zip(batch.column(0).to_pylist(), batch.column(1),
                                          batch.column(2).to_pylist(), strict=True):
                ids.append(doc_id)
                cells.append(np.frombuffer(cell.as_buffer(), kind))
                size += len(cells[-1])
                if size >= block_tokens:
                    yield row()
                    ids, cells, size, block = [], [], 0, block + 1
        if ids:
            yield row()

    ordered = (packed.where("ids IS NOT NULL").select("doc_id", "n_tokens", "ids", "kind")
               .repartitionByRange("doc_id", "n_tokens")
               .sortWithinPartitions("doc_id", "n_tokens", F.xxhash64("ids")))
    (ordered.select("doc_id", "ids", "kind").mapInArrow(coded, BLOCK_SCHEMA)
     .write.option("compression", "uncompressed").parquet(f"{out}/blocks"))
    return out


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The blocks with ``start``, the number of ids in front of each."""
    coded = spark.read.schema(BLOCK_SCHEMA).parquet(f"{folder}/blocks")
    sizes = coded.groupBy("file_part").agg(F.sum("n_tokens").alias("part_tokens"))
    up_to_here = (Window.unboundedPreceding, -1)
    parts = sizes.select("file_part", F.coalesce(F.sum("part_tokens").over(
        Window.orderBy("file_part").rowsBetween(*up_to_here)), F.lit(0)).alias("part_start"))
    places = coded.select("file_part", "block", F.coalesce(F.sum("n_tokens").over(
        Window.partitionBy("file_part").orderBy("block").rowsBetween(*up_to_here)), F.lit(0))
        .alias("in_part"))
    # Written, so that the join knows how small they are and leaves the blocks where they lie.
    starts = keep_table(places.join(parts, "file_part").select(
        "file_part", "block", (F.col("part_start") + F.col("in_part")).alias("start")),
        "token-starts")
    return coded.join(starts, ["file_part", "block"])


def _decoded(spark: SparkSession, folder: str):
    """A function that gives the documents of a batch of blocks, one after the other."""
    stored = spark.read.parquet(f"{folder}/table").first()
    symbols = np.array(stored["symbols"], dtype=np.uint32)
    freq, bits = np.array(stored["frequencies"]), stored["scale_bits"]

    def documents(batches):
        table = rans.Table(symbols, freq, bits)
        for batch in batches:
            for row in range(batch.num_rows):
                start, ids, lengths = (batch.column(i)[row].as_py() for i in range(3))
                flat = rans.decode(batch.column(3)[row].as_buffer(), table)
                ends = np.cumsum([0, *lengths])
                yield [(d, start + int(a), flat[a:b])
                       for d, a, b in zip(ids, ends[:-1], ends[1:], strict=True)]

    return documents


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, ids``: the documents of token files. Damaged blocks fail."""
    documents = _decoded(spark, folder)

    def rows(batches):
        for found in documents(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, *_ in found], pa.int64()),
                 pa.array([s for _, s, _ in found], pa.int64()),
                 pa.array([x.astype(np.int64) for *_, x in found], pa.list_(pa.int64()))],
                ["doc_id", "start", "ids"])

    return (blocks(spark, folder).select("start", "doc_ids", "doc_tokens", "coded")
            .mapInArrow(rows, "doc_id bigint, start bigint, ids array<bigint>"))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of the documents of token files."""
    documents = _decoded(spark, folder)

    def rows(batches):
        for found in documents(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, *_ in found], pa.int64()),
                 pa.array([s for _, s, _ in found], pa.int64()),
                 pa.array([len(x) for *_, x in found], pa.int64()),
                 pa.array([rans.crc(x) for *_, x in found], pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return (blocks(spark, folder).select("start", "doc_ids", "doc_tokens", "coded")
            .mapInArrow(rows, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"))
