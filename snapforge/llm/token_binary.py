"""Token ids in Simple-8b files, in the order of document ids.

Documents are dealt by ranges of their id, which Spark finds from a sample of ids; each range is one partition, sorted,
encoded and packed (see simple8b) as it is written to one file in the shared folder:

    magic "S8F1"
    per document: i64 document id, u8 1 (0: the id was null), then its Simple-8b record

A file is written under a name of its own and then renamed, so a task that runs twice leaves one whole file. Where a
document's ids begin in the whole sequence comes from the counts of the files before it (a row for each file) and of the
documents before it in its file. Readers stream a file document by document.

The library encodes each distinct piece of a text once while the memo holds it; texts with code points on which two
engines' tables may differ, or with the string of an added token (which the library turns into that token's id), are
handed to the library whole.

Nulls: a null text is the empty text (the end id alone). A null document id sorts first and stays null. Documents with
equal ids are separate, in the order of their texts' hashes; many documents with one id are dealt by these hashes too. Empty tables give no file and an empty result. Other columns
are not read.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from snapforge.llm import simple8b
from snapforge.llm.common import arrow_map, chunks, qualified, scratch_path, written
from snapforge.llm.pieces import _PLAIN, PieceMemo, is_plain

MAGIC = b"S8F1"
#: Bytes of packed ids in a file, about.
FILE_BYTES = 16_000_000
_HEAD = "<qB"
_HEAD_BYTES = struct.calcsize(_HEAD)


class LibraryEncoder:
    """Ids by the tokenizers library, with no special tokens added; their strings in a text are what the library makes of them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # For pieces: the same model, fed the byte alphabet itself, with byte FF between pieces; no UTF-8 text has it.
        self.by_piece = Tokenizer.from_file(path)
        self.by_piece.encode_special_tokens = True
        self.alphabet = _byte_alphabet()
        self.mark = self.by_piece.token_to_id(chr(self.alphabet[0xFF]))
        self.by_piece.pre_tokenizer = pre_tokenizers.Split(chr(self.alphabet[0xFF]), "isolated")
        self.memo = PieceMemo(_PLAIN.findall, self._encode_pieces if self.mark is not None else self._encode)

    def _encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"\xff".join([p.encode() for p in pieces]).decode("latin-1").translate(self.alphabet)
        ids = np.array(self.by_piece.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
        return ids[ids != self.mark], np.diff(np.concatenate(([-1], ends))) - 1

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for ids in found for i in ids), np.uint32, int(lens.sum()))
        return flat, lens

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each text has."""
        plain = [is_plain(t) and not any(a in t for a in self.added) for t in texts]
        if all(plain):
            return self.memo.ids(texts)
        flat, lens = self.memo.ids([t for t, p in zip(texts, plain) if p])
        fast = iter(np.split(flat, np.cumsum(lens)[:-1])) if len(lens) else iter(())
        every = [next(fast) if p else self._encode([t])[0] for t, p in zip(texts, plain)]
        return np.concatenate(every), np.fromiter(map(len, every), np.int64, len(every))


def _byte_alphabet() -> dict[int, int]:
    """The code point that stands for each byte in byte-level vocabularies: printable Latin-1 ones stand for themselves,
    the others take the code points from 256 up in turn."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=1)
def library(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def n_files(docs: DataFrame, text: str = "text", file_bytes: int = FILE_BYTES) -> int:
    """How many files of about ``file_bytes`` the texts' ids take. Bytes are counted: estimates of a plan's size can be far off."""
    return 1 + (docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) * 3 // 4 // file_bytes


def write_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str, files: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Encodes each document, with the end id, writes a file for each range of ids that has documents, and returns
    (shard, path, n_ids): a row for each file, shards in the order of ids."""

    def run(batches):
        from pyspark import TaskContext

        lib, (fs, base) = library(vocabulary), _filesystem(folder)
        shard, out, count = TaskContext.get().partitionId(), None, 0
        mine = f"{base}/.part-{shard:06d}-{uuid.uuid4().hex}"
        for whole in batches:
            for b in chunks(whole, "text"):
                ids, lens = lib.ids([t or "" for t in b.column("text").to_pylist()])
                sizes = lens.astype(np.int64) + 1
                records = simple8b.encode(np.insert(ids, np.cumsum(lens, dtype=np.int64), end_id), sizes)
                if out is None:
                    out = fs.open_output_stream(mine)
                    out.write(MAGIC)
                out.write(b"".join([struct.pack(_HEAD, i or 0, i is not None) + r for i, r in zip(b.column("doc_id").to_pylist(), records)]))
                count += int(sizes.sum())
        if out is not None:
            out.close()
            path = f"{base}/part-{shard:06d}.s8f"
            fs.move(mine, path)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([path]), pa.array([count], pa.int64())], names=["shard", "path", "n_ids"])

    fs, base = _filesystem(folder)
    fs.create_dir(base, recursive=True)
    place = [F.col("doc_id").asc_nulls_first(), F.col("print")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(files, *place).sortWithinPartitions(*place).select("doc_id", "text")
    return written(arrow_map(dealt, run, "shard int, path string, n_ids long"), "id-files")


def _filesystem(folder: str):
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def stream(path: str, folder: str) -> Iterator[tuple[int | None, bytes]]:
    """(document id, record) of a file, one after the other."""
    fs, _ = _filesystem(folder)
    with fs.open_input_stream(path, buffer_size=1 << 20) as f:
        if f.read(4) != MAGIC:
            raise ValueError(f"{path}: not a file of this format")
        while head := f.read(_HEAD_BYTES + 12):
            i, there = struct.unpack_from(_HEAD, head)
            _, blocks, words = struct.unpack_from("<III", head, _HEAD_BYTES)
            body = f.read(4 * blocks + 8 * words)
            if len(body) != 4 * blocks + 8 * words:
                raise ValueError(f"{path}: the file is cut short")
            yield (i if there else None), head[_HEAD_BYTES :] + body


def read_files(files: DataFrame, folder: str, with_ids: bool = False, chunk: int = 1 << 21) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), and ids (binary) if asked for, of all documents in the files."""
    based = files.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                held, size = [], 0
                for one in stream(path, folder):
                    held.append(one)
                    size += len(one[1])
                    if size > chunk:
                        out, base = rows(held, base)
                        yield out
                        held, size = [], 0
                if held:
                    yield rows(held, base)[0]

    def rows(held, base):
        ids, sizes = simple8b.decode([r for _, r in held])
        raw = ids.astype("<u4").tobytes()
        ends = np.cumsum(sizes)
        cuts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), sizes.tolist())]
        cols = [pa.array([i for i, _ in held], pa.int64()), pa.array(base + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([zlib.crc32(c) for c in cuts], pa.int64())]
        if with_ids:
            cols.append(pa.array(cuts, pa.binary()))
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)]), base + int(sizes.sum())

    n = max(1, files.count())
    return arrow_map(based.repartition(n, "shard"), run, schema)


def store(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, file_bytes: int = FILE_BYTES) -> tuple[DataFrame, str]:
    """Encode, write the files, and return their list and folder."""
    folder = qualified(spark, folder or scratch_path(spark, "token-ids"))
    return write_files(docs, vocabulary, end_id, folder, n_files(docs, file_bytes=file_bytes)), folder
