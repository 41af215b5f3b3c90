"""Token files: independent zstandard frames, one per document, and a seek table at the end.

A file is in the public seekable format: a row of frames, then a skippable
frame with the seek table (compressed size, size and checksum of each frame,
and a footer), which is the file's last byte. The last entry of the table is a
skippable frame of its own, with the documents' ids; it holds no content. Each
frame has zstandard's own checksum as well. Readers open the table from the end
and decompress only the frames they want.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tokenizers
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.llm import words as W
from inkframe.llm.memory import Memory
from inkframe.llm.store import Store

NAMES_MAGIC = 0x184D2A50
TABLE_MAGIC = 0x184D2A5E
FOOTER_MAGIC = 0x8F92EAB1
FOOTER = struct.Struct("<IBI")
NAME = np.dtype([("null", "<u1"), ("id", "<i8")])
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
#: A file is closed at this size; one document's frame is never split.
FILE_BYTES = 16 << 20
#: Words, and parts of words, in each of the two generations that a worker remembers.
REMEMBERED = 450_000
LONGEST = 256
#: Folder of the table of files, hidden from readers of the folder.
INDEX = "_index"
#: A table of files up to this many rows is broadcast; a larger one is joined by path.
BROADCAST_FILES = 100_000


def _check(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


def seal(names: list[int | None], frames: list[bytes], entries: list[tuple[int, int, int]]) -> bytes:
    """The bytes of a file."""
    name = np.zeros(len(names), NAME)
    name["null"] = [x is None for x in names]
    name["id"] = [0 if x is None else x for x in names]
    listed = name.tobytes()
    every = [*entries, (8 + len(listed), 0, _check(b""))]
    table = np.array(every, ENTRY).tobytes() + FOOTER.pack(len(every), 0x80, FOOTER_MAGIC)
    return b"".join(
        [*frames, struct.pack("<II", NAMES_MAGIC, len(listed)), listed, struct.pack("<II", TABLE_MAGIC, len(table)), table]
    )


@dataclass(frozen=True)
class TokenFile:
    """A file's seek table, and access to single documents."""

    content: memoryview
    names: list[int | None]
    entries: np.ndarray
    starts: np.ndarray

    @classmethod
    def open(cls, content: bytes) -> "TokenFile":
        view = memoryview(content)
        if len(view) < FOOTER.size:
            raise ValueError("not a token file, or cut off")
        n, flags, magic = FOOTER.unpack(view[-FOOTER.size :])
        if magic != FOOTER_MAGIC or flags != 0x80 or not n:
            raise ValueError("not a token file, or cut off")
        low = len(view) - FOOTER.size - n * ENTRY.itemsize
        every = np.frombuffer(view[low : low + n * ENTRY.itemsize], ENTRY)
        low -= 8 + (n - 1) * NAME.itemsize
        name = np.frombuffer(view[low : low + (n - 1) * NAME.itemsize], NAME)
        names = [None if gone else i for gone, i in zip(name["null"].tolist(), name["id"].tolist(), strict=True)]
        starts = np.append(0, np.cumsum(every["packed"].astype(np.int64)))
        return cls(view, names, every[:-1], starts)

    def raw(self, i: int) -> bytes:
        """The ids of the file's document i as little-endian 32-bit integers."""
        frame = self.content[int(self.starts[i]) : int(self.starts[i + 1])]
        out = zstandard.ZstdDecompressor().decompress(frame)
        if len(out) != int(self.entries["size"][i]) or _check(out) != int(self.entries["check"][i]):
            raise ValueError(f"frame {i} is damaged")
        return out

    def ids(self, i: int) -> np.ndarray:
        return np.frombuffer(self.raw(i), "<u4")


class Encoder:
    """Encodes texts word by word and remembers words, and the parts that the splitter makes of them.

    The tokenizer's normaliser and splitter never look across the six bytes of
    ASCII white space, so a text's ids are those of its words in turn. New words
    are normalised in one call and cut with the splitter's own pattern; new
    parts are encoded in one call by the same model, past the normaliser and
    the splitter, and the ids dealt back: the last id of a part, and no other,
    ends a word. For words of the Latin blocks the normaliser only lower-cases,
    which is held against it once. Words beyond the Latin blocks, on which
    libraries of patterns may differ, and words with white space beyond ASCII
    or a special token's text are encoded alone.
    """

    GROUP = 4096

    def __init__(self, path: str):
        self.whole = tokenizers.Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            listed = json.load(file)
        suffix = listed["model"]["end_of_word_suffix"]
        splitter = listed["pre_tokenizer"]["pretokenizers"][0]
        kinds = [x["type"] for x in listed["normalizer"]["normalizers"]]
        if not suffix or splitter["type"] != "Split" or not splitter["invert"] or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path} has another normaliser or splitter than this encoder knows")
        self.split = regex.compile(splitter["pattern"]["Regex"] + "| ")
        self.cut = tokenizers.Tokenizer.from_str(json.dumps(listed | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None}))
        self.letters = _letters(tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        latin = " ".join(c for c in map(chr, range(0x250)) if _LATIN(c) and c != " ")
        self.lowers = self.whole.normalizer.normalize_str(latin) == latin.lower()
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words = Memory(REMEMBERED)
        self.parts = Memory(REMEMBERED)

    def _alone(self, word: str) -> bytes:
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_parts(self, parts: list[str]) -> None:
        young = self.parts.young
        for at in range(0, len(parts), self.GROUP):
            group = parts[at : at + self.GROUP]
            spelt = " ".join(group).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.cut.encode_batch_fast([spelt], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != len(group):
                young.update((part, self._alone(part)) for part in group)
                continue
            packed, low = ids.tobytes(), 0
            for part, end in zip(group, (4 * ends).tolist(), strict=True):
                young[part] = packed[low:end]
                low = end

    def _learn(self, words: list[bytes]) -> None:
        known = self.words.young
        joined = b" ".join(words).decode()
        if not _LATIN(joined) or any(s in joined for s in self.special):
            rest = [w for w in words if _LATIN(w.decode()) and not any(s in w.decode() for s in self.special)]
            known.update((w, self._alone(w.decode())) for w in set(words).difference(rest))
            words, joined = rest, b" ".join(rest).decode()
        if not words:
            return
        made = joined.lower() if self.lowers or joined.isascii() else self.whole.normalizer.normalize_str(joined)
        parts = self.split.findall(made)
        distinct = set(parts)
        distinct.discard(" ")
        missing = self.parts.lacking(distinct)
        self._learn_parts(list(missing))
        self.parts.young[" "] = b""
        found = list(map(self.parts.young.__getitem__, parts))
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        cuts = [0, *ends[np.fromiter(map(" ".__eq__, parts), bool, len(parts))].tolist(), int(ends[-1])]
        if len(cuts) != len(words) + 1:
            raise RuntimeError("the normaliser joins or cuts words")
        packed = b"".join(found)
        known.update(zip(words, (packed[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))
        if not _LATIN(made):
            known.update((w, self._alone(w.decode())) for w, m in zip(words, made.split(" "), strict=True) if not _LATIN(m))
        self.parts.forget(p for p in missing if len(p) > LONGEST)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers.

        A-Z are lower-cased first, as the normaliser does later, unless that
        could make a special token's text.
        """
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        missing = self.words.lacking(set().union(*split))
        if missing:
            self._learn(list(missing))
        get = self.words.young.__getitem__
        out = [b"".join(map(get, s)) for s in split]
        self.words.forget(raw for raw in missing if len(raw) > LONGEST)
        return out


#: Words of the Latin blocks, without white space beyond ASCII (U+001C to U+001F, U+0085, U+00A0).
_LATIN = re.compile("[ -~\u00a1-\u024f]+").fullmatch


def _letters(level: tokenizers.pre_tokenizers.ByteLevel) -> dict[int, str]:
    """The letter by which the library spells each byte of UTF-8; a space stays, as it is between parts only."""
    sample = "".join(map(chr, [*range(0x800), *range(0x800, 0xD800, 0x800), *range(0xE000, 0x10000, 0x800), *range(0x10000, 0x110000, 0x10000)]))
    spelt = "".join(piece for piece, _ in level.pre_tokenize_str(sample))
    return dict(zip(sample.encode(), spelt, strict=True)) | {32: " "}


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a tokenizer file, made once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pack_files(documents: DataFrame, tokenizer: str, end: int, level: int = 1, file_bytes: int = FILE_BYTES) -> DataFrame:
    """One row per file: its bytes, documents in the order of the partition's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = encoder(tokenizer)
        press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        closing = struct.pack("<I", end)
        names: list[int | None] = []
        frames: list[bytes] = []
        entries: list[tuple[int, int, int]] = []
        held = 0

        def close() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([seal(names, frames, entries)], pa.binary())], names=["file"])
            for x in (names, frames, entries):
                x.clear()
            return batch

        for batch in batches:
            data, offsets = W.buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for low, high in W.slices(offsets):
                texts = [data[offsets[i] : offsets[i + 1]].tobytes() for i in range(low, high)]
                for name, found in zip(ids[low:high], made.encode(texts), strict=True):
                    raw = found + closing
                    frame = press.compress(raw)
                    names.append(name)
                    frames.append(frame)
                    entries.append((len(frame), len(raw), _check(raw)))
                    held += len(frame)
                if held >= file_bytes:
                    yield close()
                    held = 0
        if names:
            yield close()

    return documents.mapInArrow(run, "file binary")


def write_tokens(documents: DataFrame, folder: str, tokenizer: str, end: int = 2, file_bytes: int = FILE_BYTES) -> None:
    """Write ``documents(doc_id, text)`` as token files in ascending doc_id order, and the table of files.

    Null texts are empty; an empty text has the end id alone. Files hold
    consecutive ranges of doc_id (nulls first; rows that repeat a doc_id in any
    order) and are named by partition and number. Spark's own writer writes
    them, so they reach any store that Spark writes to and a lost task leaves
    nothing behind. It ends each row with a separator, which is here the four
    bytes that end a seek table.
    """
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files = pack_files(ordered, tokenizer, end, file_bytes=file_bytes)
    closing = struct.pack("<I", FOOTER_MAGIC)
    body = F.expr(f"substring(file, 1, octet_length(file) - {len(closing)})").cast("string")
    writer = files.select(body.alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1)
    writer.option("encoding", "ISO-8859-1").option("lineSep", closing.decode("latin-1")).text(folder)
    _write_index(documents.sparkSession, folder)


def _opened(frame: DataFrame, schema: str, row: Callable[[str, TokenFile], pa.RecordBatch]) -> DataFrame:
    """``row(name, file)`` of each file; names are relative to the folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                yield row(path.rsplit("/", 1)[-1], TokenFile.open(content.as_buffer()))

    return frame.select("path", "content").mapInArrow(run, schema)


def _write_index(spark: SparkSession, folder: str) -> None:
    """A row per file: its name, ids before it, and its least and greatest doc_id.

    Running sums go partition by partition; the only task over all of them
    reads one row per written partition.
    """

    def row(name: str, file: TokenFile) -> pa.RecordBatch:
        known = [x for x in file.names if x is not None]
        values = [name, int(file.entries["size"].astype(np.int64).sum()) // 4, min(known, default=None), max(known, default=None), len(known) < len(file.names)]
        return pa.RecordBatch.from_pylist([dict(zip(("name", "tokens", "first", "last", "nulls"), values, strict=True))], schema=kinds)

    kinds = pa.schema([("name", pa.string()), ("tokens", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("nulls", pa.bool_())])
    files = _opened(_files(spark, folder), "name string, tokens long, first long, last long, nulls boolean", row)
    number = [F.regexp_extract("name", r"^part-(\d+)-.*-c(\d+)", i).cast("long").alias(n) for i, n in ((1, "part"), (2, "piece"))]
    store = Store(spark, "tokens")
    files = store.put("files", files.select("*", *number))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("tokens").alias("t")).select("part", F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    files.join(parts, "part").select("name", start.alias("base"), "first", "last", "nulls").write.parquet(f"{folder.rstrip('/')}/{INDEX}")
    store.drop("files")


def _files(spark: SparkSession, folder: str, names: list[str] | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "part-*")
    return reader.load(folder if names is None else [f"{folder.rstrip('/')}/{n}" for n in names])


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and checksum of its ids.

    ``start`` counts the ids of all documents before it, in file order. A
    damaged frame raises an error.
    """

    def row(name: str, file: TokenFile) -> pa.RecordBatch:
        sizes = file.entries["size"].astype(np.int64) // 4
        checks = [zlib.crc32(file.raw(i)) for i in range(len(sizes))]
        columns = [pa.array([name] * len(sizes), pa.string()), pa.array(file.names, pa.int64()), pa.array(np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(checks, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["name", "doc_id", "inside", "n_tokens", "ids_crc32"])

    index = spark.read.parquet(f"{folder.rstrip('/')}/{INDEX}").select("name", "base")
    if index.count() <= BROADCAST_FILES:
        index = F.broadcast(index)
    found = _opened(_files(spark, folder), "name string, doc_id long, inside long, n_tokens long, ids_crc32 long", row)
    return found.join(index, "name").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the requested documents.

    Only files whose range of doc_id holds a requested one are read, and of
    those only the requested frames are decompressed. Ids that no file has give
    no row; an empty list gives an empty result.
    """
    wanted = set(doc_ids)
    asked = spark.createDataFrame([(i,) for i in sorted(wanted)], "id long")
    index = spark.read.parquet(f"{folder.rstrip('/')}/{INDEX}")
    names = [r["name"] for r in index.join(F.broadcast(asked), F.col("id").between(F.col("first"), F.col("last")), "left_semi").collect()]  # at most one range, or its repeats, per id

    def row(name: str, file: TokenFile) -> pa.RecordBatch:
        hit = [i for i, x in enumerate(file.names) if x in wanted]
        return pa.RecordBatch.from_arrays([pa.array([file.names[i] for i in hit], pa.int64()), pa.array([file.ids(i).tolist() for i in hit], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    schema = "doc_id long, ids array<long>"
    return _opened(_files(spark, folder, names), schema, row) if names else spark.createDataFrame([], schema)
