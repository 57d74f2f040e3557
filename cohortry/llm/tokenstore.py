"""Token ids in seekable zstandard files, written and read by Spark tasks.

File format (public seekable zstandard format): independent frames, each holding the ids
of whole documents as little-endian unsigned 32-bit integers, then one skippable frame
with the seek table: per zstandard frame its compressed size, its decompressed size and
the low 32 bits of the XXH64 of its content, then the number of frames, a descriptor byte
(checksums present) and the magic number. A reader needs the table and the frames that
hold the wanted documents. Where a document lies is kept in a Parquet index beside the
files: doc_id, file, frame, first id within the frame, number of ids, start.
"""

from __future__ import annotations

import gc
import os
import re
import struct
import sys
import uuid
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.llm.common import held, release
from cohortry.session import checkpoint, scratch_dir

_FRAME_BYTES = 1 << 18
_BATCH_BYTES = 12 << 20
_SEEK_FRAME, _SEEK_END = 0x184D2A5E, 0x8F92EAB1
_MEMO = 450_000
#: ASCII marks but the apostrophe, with which a contraction may begin.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters up to here are letters in every Unicode version in use.
_LETTERS = "\u2000"
#: White space, by any account, next to white space.
_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
#: A text that starts with white space other than a space or a line break: the line break
#: put before its first piece would merge with it, so the library sees it whole.
_LEADING = r"^[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _text(s: str) -> pa.Scalar:
    return pa.scalar(s, pa.large_string())


class Encoder:
    """Ids of texts under a byte-level tokenizer.

    Its pre-tokens never run from a non-space character into a space, and a line break
    between two non-space characters is a pre-token by itself. A text is therefore cut at
    single spaces and line breaks, and each different piece goes through the library once
    while it is remembered. A text in which white space meets white space, or with the
    string of a special token, goes through the library whole."""

    def __init__(self, path: str, memo: int = _MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.memo: dict[str, bytes] = {}  # and the generation before, for pieces met again
        self.older: dict[str, bytes] = {}
        self.limit = memo
        self.marks: dict[str, bytes] = {}
        self.line = self._library(["\n"])[0]
        # the characters by which byte-level tokenizers write bytes
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.bytes = {b: 256 + k for k, b in enumerate(x for x in range(256) if x not in plain)}

    def _library(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [_packed(e.ids) for e in got]

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token, which goes to the library's merges directly."""
        seen = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.bytes)
        return _packed([t.id for t in self.tokenize(seen)])

    def _learn(self, pieces: set[str]) -> None:
        memo, marks = self.memo, self.marks
        # marks right after a letter, up to the end of a piece, are a pre-token by themselves
        marked, plain = {}, []
        for p in pieces:
            stem = p.rstrip(_MARKS)
            if len(stem) < len(p) and stem[-1:].isalpha():
                marked[p] = stem
            else:
                plain.append(p)
        odd, tokenize = [], self.tokenize
        for p in {*plain, *marked.values()}.difference(memo):
            if p.isalpha() and p.isascii():
                memo[p] = _packed([t.id for t in tokenize("\u0120" + p)])
                continue
            letters = p[1:] if p[:1] == "\n" else p
            if not letters.isalpha() or max(letters) > _LETTERS:
                odd.append(p)
            elif letters is p:
                memo[p] = self._word(" " + p)
            else:
                memo[p] = self.line + self._word(letters)
        for at in range(0, len(odd), 4096):
            part = odd[at : at + 4096]
            memo.update(zip(part, self._library([p if p[:1] == "\n" else " " + p for p in part]), strict=True))
        for p, stem in marked.items():
            tail = p[len(stem) :]
            ids = marks.get(tail)
            if ids is None:
                ids = self._library([tail])[0]
                if len(marks) < 10_000:
                    marks[tail] = ids
            memo[p] = memo[stem] + ids

    def _ids(self, pieces: list[str]) -> list[bytes]:
        """Ids of some different pieces."""
        ids = list(map(self.memo.get, pieces))
        if None in ids:
            missing = {p for p, i in zip(pieces, ids, strict=True) if i is None}
            if len(self.memo) > self.limit:
                self.memo, self.older = {}, self.memo
            memo, older = self.memo, self.older
            if older:
                memo.update([(p, older[p]) for p in missing if p in older])
                missing.difference_update(memo)
            gc.disable()  # strings and bytes only: nothing there to collect
            self._learn(missing)
            gc.enable()
            ids = [memo[p] if i is None else i for p, i in zip(pieces, ids, strict=True)]
        return ids

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of whole texts. Nulls are empty.

        Pieces keep the line break before them and leave the space before them out. The
        first piece gets a line break of its own, whose id is cut off again."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.or_(pc.match_substring_regex(texts, _SPACES), pc.match_substring_regex(texts, _LEADING))
        for s in self.special:
            odd = pc.or_(odd, pc.match_substring(texts, s))
        whole = dict.fromkeys(np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist())
        usual = pc.if_else(odd, _text(""), texts) if whole else texts
        usual = pc.replace_substring(pc.binary_join_element_wise(_text(""), usual, _text("\n")), "\n", " \n")
        lists = pc.split_pattern(pc.utf8_slice_codeunits(usual, 1), " ")
        pieces = lists.flatten().dictionary_encode()
        ids = pa.array(self._ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pieces.indices)
        out = pc.binary_join(pa.ListArray.from_arrays(lists.offsets, ids), pa.scalar(b"", pa.large_binary())).to_pylist()
        out = [x[4:] for x in out]
        for k in whole:
            out[k] = self._library([texts[k].as_py()])[0]
        return out


def encoder(path: str) -> Encoder:
    return held(("encoder", path), lambda: Encoder(path))


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"\w+:/", uri) else f"file://{uri}")


def _frame(ids: bytes, compressor: zstandard.ZstdCompressor) -> tuple[bytes, tuple[int, int, int]]:
    z = compressor.compress(ids)
    return z, (len(z), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    body = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), 1 << 7, _SEEK_END)
    return struct.pack("<II", _SEEK_FRAME, len(body)) + body


def read_seek_table(f, size: int) -> np.ndarray:
    """(offset, compressed, decompressed, checksum) of each frame of an open file."""
    f.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", f.read(9))
    if magic != _SEEK_END or not flags & 1 << 7:
        raise ValueError("no seek table with checksums")
    f.seek(size - 9 - 12 * n - 8)
    head = struct.unpack("<II", f.read(8))
    if head != (_SEEK_FRAME, 12 * n + 9):
        raise ValueError("damaged seek table")
    t = np.frombuffer(f.read(12 * n), dtype="<u4").reshape(n, 3).astype(np.int64)
    return np.column_stack([np.cumsum(t[:, 0]) - t[:, 0], t])


def read_frame(f, entry: np.ndarray) -> bytes:
    """One frame, checked against its checksum."""
    at, packed, size, check = map(int, entry)
    f.seek(at)
    ids = zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=max(size, 1))
    if len(ids) != size or xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
        raise ValueError("a frame does not match its checksum")
    return ids


def merged(batches, size: int = _BATCH_BYTES):
    """Batches put together up to so many bytes, so that a piece is looked up once in more
    text."""
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def writer(folder: str, tokenizer: str, end_id: int, frame_bytes: int):
    """Write the rows of a partition, in their order, as one file; yield its index."""
    end = struct.pack("<I", end_id)

    def run(batches):
        fs, root = _filesystem(folder)
        # A name of its own for each attempt: files of attempts that were lost or ran
        # twice are in no index, so nothing reads them.
        name, out, entries, frame, size = f"{uuid.uuid4().hex}.zst", None, [], [], 0
        compressor, where = zstandard.ZstdCompressor(level=1, write_content_size=True), []

        def flush():
            z, entry = _frame(b"".join(frame), compressor)
            out.write(z)
            entries.append(entry)
            frame.clear()

        for batch in merged(batches):
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            for ids in encoder(tokenizer).encode(batch["text"].combine_chunks()):
                where.append((len(entries), size // 4, len(ids) // 4 + 1))
                frame += [ids, end]
                size += len(ids) + 4
                if size >= frame_bytes:
                    flush()
                    size = 0
            columns = zip(*where, strict=True)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].combine_chunks(), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)), pa.array([name] * len(where))], ["doc_id", "frame", "offset", "n_tokens", "file"])
            where = []
        if out is not None:
            if frame:
                flush()
            out.write(seek_table(entries))
            out.close()
        pa.default_memory_pool().release_unused()

    return run


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, frame_bytes: int = _FRAME_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, append `end_id` to each and write them in ascending id order.

    Returns the index as a table of its own: doc_id, file, frame, offset, n_tokens, start.
    Files are numbered by the range of ids they hold; rows with one id are ordered by
    the hash of their text, so a hot id is spread over files too. Null texts are empty and
    hold the end id only; null ids come first. Other columns are not read. An empty table
    gives an empty index and no files.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    index = rows.mapInArrow(writer(folder, tokenizer, end_id, frame_bytes), "doc_id bigint, frame int, offset bigint, n_tokens bigint, file string")
    kept = f"{folder}/index"
    index.withColumn("part", F.spark_partition_id()).write.parquet(kept)
    index = spark.read.parquet(kept)
    # start: ids of all files before, of all frames before in the file, and the offset
    frames = index.groupBy("part", "file", "frame").agg(F.sum("n_tokens").alias("ids"))
    files = frames.groupBy("part").agg(F.sum("ids").alias("ids"))
    frames = frames.withColumn("in_file", _before("ids", ["part"], "frame")).drop("ids", "file")
    files = files.withColumn("in_all", _before("ids", [], "part")).drop("ids")
    at = checkpoint(frames.join(files, "part").select("part", "frame", (F.col("in_file") + F.col("in_all")).alias("at")))
    index = index.join(at, ["part", "frame"])
    return index.select("doc_id", "file", "frame", "offset", "n_tokens", (F.col("at") + F.col("offset")).alias("start"))


def _before(value: str, by: list[str], order: str) -> Column:
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def read(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """Ids of the documents of an index (all or some of its rows), read from the files.

    Each task opens the files of its frames, reads their seek tables and decompresses
    only the frames that hold wanted documents. Returns doc_id, start, ids (array).
    """
    return _read(index, folder, "ids array<bigint>", lambda raw: [np.frombuffer(r, "<u4").astype(np.int64) for r in raw])


def digest(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and crc32 of the ids of the documents of an index, computed
    from what is in the files."""
    return _read(index, folder, "n_tokens bigint, ids_crc32 bigint", lambda raw: {"n_tokens": [len(r) // 4 for r in raw], "ids_crc32": [zlib.crc32(r) for r in raw]})


def _read(index: DataFrame, folder: str, columns: str, turn) -> DataFrame:
    def run(batches):
        release()
        fs, root = _filesystem(folder)
        name = table = f = None
        held: tuple = (None, None)
        try:
            for batch in batches:
                raw = []
                for file, frame, offset, n in zip(batch["file"], batch["frame"], batch["offset"], batch["n_tokens"], strict=True):
                    if file != name:
                        if f is not None:
                            f.close()
                        f, name = fs.open_input_file(f"{root}/{file}"), file
                        table = read_seek_table(f, f.size())
                    if held[0] != (file, frame):
                        held = ((file, frame), read_frame(f, table[frame]))
                    raw.append(held[1][offset * 4 : (offset + n) * 4])
                got = turn(raw)
                out = batch[["doc_id", "start"]].copy()
                for c, v in (got.items() if isinstance(got, dict) else [("ids", got)]):
                    out[c] = v
                yield out
        finally:
            if f is not None:
                f.close()

    rows = index.repartition("file", "frame").sortWithinPartitions("file", "frame", "offset")
    return rows.mapInPandas(run, f"doc_id bigint, start bigint, {columns}")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, **columns: str) -> DataFrame:
    """Write the documents to a fresh folder in the shared storage and read them back:
    doc_id, start, n_tokens, ids_crc32."""
    folder = scratch_dir(docs.sparkSession, "tokens-")
    index = write(docs, folder, tokenizer, end_id, **columns)
    return digest(docs.sparkSession, folder, index)
