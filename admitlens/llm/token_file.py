"""Token-ID output as bit-plane shuffled, compressed files (operator 7).

Documents are put in order by range partitions and encoded where they lie; each
task writes its ids as segments of whole documents. A segment is one file image:
a header, a document table and a chunk index, then chunks of a fixed number of
ids. A chunk is transposed into bit planes (or byte planes) and every plane is
compressed by zstandard on its own. Segments are stored through Spark's Parquet
writer, one image per row, so any store that Spark reaches will do, and a lost
task's output is never half there.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import types
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from admitlens.session import scratch_path

MAGIC = b"BPL1"
CHUNK_IDS = 1 << 16      # ids in a chunk, but for a segment's last
SEGMENT_IDS = 1 << 20    # a segment closes at the first document that ends beyond
END_ID = 0
CACHED_UNITS = 1_000_000   # encoded units a worker remembers
ENCODE_CHARS = 1 << 14   # characters given to the tokenizer at once

# Unicode white space, the only place where the byte-level split looks around
# itself: a unit is a run of other characters with the one blank before it, or a
# run of white space without that blank.
_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
                           0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_LETTERS = "A-Za-z" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F)))
# Points and commas behind a letter at the end of a run are a unit of their own.
_UNITS = re.compile(rf" ?[^{_SPACE}.,]+(?:[.,]+[^{_SPACE}.,]+)*(?:(?<![{_LETTERS}])[.,]+)?|[.,]+(?=[{_SPACE}]|\Z)"
                    rf"| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_WORD = re.compile(rf" ?[{_LETTERS}]+")
# The byte-level spelling: printable bytes stand for themselves, the rest for the
# characters from 256 on, in order.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_REST = [b for b in range(256) if b not in _PRINTED]
_BYTES = {b: chr(b) for b in _PRINTED} | {b: chr(256 + i) for i, b in enumerate(_REST)}


def _pieces(units: list[str], chars: int) -> Iterator[list[str]]:
    row, size = [], 0
    for u in units:
        row.append(u)
        size += len(u)
        if size >= chars:
            yield row
            row, size = [], 0
    if row:
        yield row


class Encoder:
    """Whole-text encoding by the tokenizers library with memory of units.

    For a byte-level tokenizer that splits by its own pattern, ids of a text are
    the ids of its units in a row, so each distinct unit is encoded once. Texts
    that hold an added token, and any other kind of tokenizer, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        config = json.loads(self.tokenizer.to_str())
        pre = config.get("pre_tokenizer") or {}
        self.by_unit = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
                        and not pre.get("add_prefix_space") and not config.get("normalizer"))
        self.added = [t["content"] for t in config.get("added_tokens", [])]
        self.memory: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.opens = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        for token, i in vocabulary.items():      # byte-level spelling of a blank
            self.opens[i] = token.startswith(chr(0x120))
        line_end = self._ids("\n")
        self.line_end = int(line_end[0]) if len(line_end) == 1 else -1

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _remember(self, units: list[str]) -> None:
        """Encode units many at a time. Those that open with a blank stand one
        behind the other, and a token that opens with a blank begins the next;
        those that open with another character stand behind line ends."""
        memory = self.memory
        blank, plain = [], []
        word, model = _WORD.fullmatch, self.tokenizer.model
        for u in units:
            if word(u):              # one piece of the split: the model alone
                ids = [t.id for t in model.tokenize(u.encode().decode("latin-1").translate(_BYTES))]
                memory[u] = struct.pack(f"<{len(ids)}I", *ids)
            elif u[0] not in _SPACE:
                plain.append(u)
            elif len(u) > 1 and u[0] == " " and u[1] not in _SPACE:
                blank.append(u)
            else:
                memory[u] = self._ids(u).tobytes()
        for row, ends in ((blank, None), (plain, "\n")):
            for some in _pieces(row, ENCODE_CHARS):
                if ends is None:
                    ids = self._ids("".join(some))
                    cuts, skip = 4 * np.flatnonzero(self.opens[ids]), 0
                else:
                    ids = self._ids(ends + ends.join(some))
                    cuts, skip = 4 * np.flatnonzero(ids == self.line_end), 4
                if len(cuts) == len(some):
                    data, cuts = ids.tobytes(), cuts.tolist()
                    for u, a, b in zip(some, cuts, [*cuts[1:], len(data)]):
                        memory[u] = data[a + skip:b]
                else:
                    memory.update((u, self._ids(u).tobytes()) for u in some)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.by_unit or any(a in text for a in self.added):
            return self._ids(text).tobytes()
        units = _UNITS.findall(text)
        memory = self.memory
        parts = list(map(memory.get, units))
        if None in parts:
            new = {u for u, p in zip(units, parts) if p is None}
            if len(memory) + len(new) > CACHED_UNITS:
                memory.clear()
            self._remember(list(new))
            parts = [memory[u] if p is None else p for u, p in zip(units, parts)]
        return b"".join(parts)


def encoder(path: str) -> Encoder:
    """One per worker process and file: tasks that a worker runs share its memory
    (kept beside the modules, since this package may travel by value)."""
    kept = sys.modules.setdefault("_token_file_encoders", types.ModuleType("_token_file_encoders"))
    if path not in kept.__dict__:
        kept.__dict__[path] = Encoder(path)
    return kept.__dict__[path]


def to_planes(ids: np.ndarray, planes: str = "byte") -> list[bytes]:
    """Transpose ids: plane j holds bit (or byte) j of every id."""
    by = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [by[:, j].tobytes() for j in range(4)]
    bits = np.unpackbits(by, axis=1, bitorder="little")
    return [np.packbits(bits[:, j], bitorder="little").tobytes() for j in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        by = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little", count=n) for p in planes], axis=1)
        by = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(by).view("<u4").reshape(-1)


def pack_segment(doc_ids: list, counts: list[int], ids: np.ndarray, planes: str = "byte",
                 chunk_ids: int = CHUNK_IDS, level: int = 3) -> bytes:
    """The image of a segment. Header: magic, planes per chunk, ids per chunk,
    documents, chunks. Then per document its id (a null one flagged) and count;
    per chunk its ids and the compressed length of each plane; then the planes."""
    z = zstandard.ZstdCompressor(level=level)
    n_planes = 4 if planes == "byte" else 32
    index, body = [], []
    for a in range(0, len(ids), chunk_ids):
        part = ids[a:a + chunk_ids]
        packed = [z.compress(p) for p in to_planes(part, planes)]
        index.append(struct.pack(f"<I{n_planes}I", len(part), *map(len, packed)))
        body += packed
    docs = [struct.pack("<?qQ", d is None, d or 0, c) for d, c in zip(doc_ids, counts)]
    head = MAGIC + struct.pack("<IIQQ", n_planes, chunk_ids, len(docs), len(index))
    return b"".join([head, *docs, *index, *body])


def read_table(image: bytes) -> tuple[list, list[int], list[tuple[int, int, list[int]]]]:
    """Document ids, counts, and the chunk index (offset, ids, plane lengths)."""
    if image[:4] != MAGIC:
        raise ValueError("not a token segment")
    n_planes, _, n_docs, n_chunks = struct.unpack_from("<IIQQ", image, 4)
    at = 4 + struct.calcsize("<IIQQ")
    docs = list(struct.iter_unpack("<?qQ", image[at:at + 17 * n_docs]))
    at += 17 * n_docs
    size = 4 + 4 * n_planes
    offset, chunks = at + size * n_chunks, []
    for i in range(n_chunks):
        n, *lengths = struct.unpack_from(f"<I{n_planes}I", image, at + size * i)
        chunks.append((offset, n, lengths))
        offset += sum(lengths)
    return [None if null else d for null, d, _ in docs], [c for _, _, c in docs], chunks


def read_chunk(image: bytes, chunk: tuple[int, int, list[int]]) -> np.ndarray:
    """One chunk alone: the index makes any of them reachable."""
    z = zstandard.ZstdDecompressor()
    at, n, lengths = chunk
    planes = []
    for length in lengths:
        planes.append(z.decompress(image[at:at + length]))
        at += length
    return from_planes(planes, n)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID,
                 planes: str = "byte", segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every text, append ``end_id``, write segments in ascending doc_id
    order below ``path`` (columns part, place, first, n_ids, image). Null texts
    are empty; null ids come first; rows of one id are ordered by text. Empty
    tables give an empty data set. Other columns are not read."""
    def run(batches):
        encode = encoder(tokenizer).encode
        end = np.array([end_id], dtype="<u4").tobytes()
        part = TaskContext.get().partitionId()
        first, names, counts, parts, size, place = 0, [], [], [], 0, 0

        def segment():
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            image = pack_segment(names, counts, ids, planes)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], pa.int64()) for x in (part, place, first, size)] + [pa.array([image], pa.binary())],
                ["part", "place", "first", "n_ids", "image"])

        for batch in batches:
            for d, t in zip(batch.column(0), batch.column(1)):
                data = encode(t.as_py() or "") + end
                names.append(d.as_py())
                counts.append(len(data) // 4)
                parts.append(data)
                size += len(data) // 4
                if size >= segment_ids:
                    yield segment()
                    first, place = first + size, place + 1
                    names, counts, parts, size = [], [], [], 0
        if names:
            yield segment()

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
     .repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(run, "part long, place long, first long, n_ids long, image binary")
     .write.option("compression", "none").parquet(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens,
    ids_crc32 (of the little-endian 32-bit ids), in bounded pieces."""
    segments = spark.read.schema("part long, place long, first long, n_ids long, image binary").parquet(path)
    # One number per writing task, added up over those few rows.
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))

    def run(batches):
        for batch in batches:
            for start, image in zip(batch.column("start"), batch.column("image")):
                start, image = start.as_py(), image.as_py()
                names, counts, chunks = read_table(image)
                out, crc, doc, left = [], 0, 0, counts[0] if counts else 0
                for chunk in chunks:
                    data = memoryview(read_chunk(image, chunk).tobytes())
                    while len(data):
                        n = min(left, len(data) // 4)
                        crc = zlib.crc32(data[:4 * n], crc)
                        data, left = data[4 * n:], left - n
                        if not left:
                            out.append(crc)
                            crc, doc = 0, doc + 1
                            left = counts[doc] if doc < len(counts) else 0
                starts = start + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(starts), pa.array(counts, pa.int64()),
                     pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return (segments.join(offsets, "part")
            .select((F.col("before") + F.col("first")).alias("start"), "image")
            .mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_file(docs: DataFrame, tokenizer: str, **how) -> DataFrame:
    """Write ``docs`` to a fresh place in the shared folder and read it back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, **how)
    return read_tokens(docs.sparkSession, path)
