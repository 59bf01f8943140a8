"""Token-ID files: independent zstandard frames with a trailing seek table.

A file holds the ids of a range of documents in ascending order of doc_id, or of another column
that is asked for, such as the key of a mix; ids are little-endian, 16 bits wide where the
vocabulary allows. Whole documents are gathered into frames of about FRAME
bytes, each compressed on its own with zstandard's content checksum. After the frames come two
skippable frames: the document index (doc_id, number of ids, frame, place in it) and the seek
table of the public zstandard seekable format, with sizes and a checksum of each frame. A
reader takes the tail first and then decompresses only the frames of the documents it wants.

Tasks write under a name of their own and rename when done; only files of the written manifest
count, so a task that is run again leaves at most an unused file.

The number of files follows from the bytes of the texts.

Defined results: null counts as empty; an empty text is the end id alone; equal doc_ids are
ordered by a hash of the text; null doc_ids come first; a doc_id must be a whole number, and one
that does not read as such raises an error; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import os
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_column, doc_groups, kept, materialise, new_path, relieved

FRAME = 128 << 10
#: Bytes of text that a file is meant to hold; a task sorts and writes one file.
FILE_BYTES = 16 << 20
#: Words whose ids a worker remembers, at least, and twice as many at most.
CACHE = 300_000
#: Bytes of text that are cut into words at a time; each distinct word of them is looked up once.
GROUP = 2 << 20
#: Bytes of a word that is remembered as one; a longer one goes by its pieces.
LONG = 64
# Fixed values of the public seekable format: magic numbers of the seek table's frame and footer, and of our index frame.
SEEK_MAGIC, FOOTER_MAGIC, INDEX_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
# Fixed value: the split of byte-level BPE with its standard expression.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes by kind: 0 controls, 1 letters and digits, 2 signs, 3 apostrophe, 4 white space, 5 part of a character beyond ASCII.
_KINDS = np.array([5 if b > 127 else 1 if chr(b).isalnum() else 3 if b == 39 else 2 if 32 < b < 127 else 4 if b == 32 or 8 < b < 14 else 0 for b in range(256)], np.uint8)
#: By kinds of a byte and of the next: 1, pieces of SPLIT end between them wherever they stand; 2, they do if the first byte ends a letter.
_CUTS = np.array([[0, 0, 0, 0, 0, 0], [0, 0, 1, 1, 1, 0], [0, 1, 0, 0, 1, 0], [0, 0, 0, 0, 1, 0], [0, 0, 0, 0, 0, 0], [0, 0, 2, 2, 2, 0]], np.uint8).ravel()
#: Letters of up to three bytes.
_LETTERS = np.array([chr(c).isalpha() for c in range(1 << 16)])


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words start in the bytes of texts; a word is a run of whole pieces of SPLIT and lies within one text.

    No piece goes on from a letter, digit or sign into white space, from a letter or digit into a sign, or from
    a sign into letters or digits, but for an apostrophe. Runs of white space stay with what follows them, as
    their pieces depend on it; a line end by itself is a piece.
    """
    kinds = _KINDS[data]
    cut = np.zeros(len(data), np.uint8)
    cut[1:] = _CUTS[kinds[:-1] * np.uint8(6) + kinds[1:]]
    at = np.flatnonzero(cut == 2)
    x, y, z = (data[at - k].astype(np.int32) for k in (1, 2, 3))
    two, three = (y & 31) << 6 | x & 63, (z & 15) << 12 | (y & 63) << 6 | x & 63
    cut[at] = np.where(y >= 0xC0, _LETTERS[two], (z >= 0xE0) & (z < 0xF0) & _LETTERS[three])
    cut[offsets[:-1][offsets[:-1] < len(data)]] = 1
    ends = np.flatnonzero(data[:-1] == 10)
    cut[ends[(cut[ends] == 1) & (kinds[ends + 1] > 0) & (kinds[ends + 1] < 4)] + 1] = 1
    return np.flatnonzero(cut)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE writes each byte as one printable letter: itself, or the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts by the tokenizers library; words met before are looked up.

    Texts are cut into words many at a time. Arrow numbers the distinct ones, and only these are looked up or
    given to the library; the texts' ids are then gathered by number.
    """

    @classmethod
    def of_worker(cls, path: str, end: int) -> Encoder:
        """The encoder that this worker process keeps from task to task, with the words it knows."""
        mine = kept("tokens")
        if (path, end) not in mine:
            mine[path, end] = cls(path, end)
        return mine[path, end]

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        self.by_word = self.tokenizer.normalizer is None and isinstance(pre, ByteLevel) and not pre.add_prefix_space and pre.use_regex
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([end], self.kind).tobytes()
        self.find = regex.compile(SPLIT).findall
        self.known: dict[bytes, bytes] = {}
        self.former: dict[bytes, bytes] = {}
        letters = _byte_letters()
        self.letters, self.merge = "".join(chr(letters.get(b, b)) for b in range(256)), self.tokenizer.model.tokenize

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these distinct words."""
        if len(self.known) > CACHE:
            # words that come again move on to the new generation, the others are forgotten with the next
            self.former, self.known = self.known, {}
        out, code, rest = list(map(self.known.get, words)), self.kind.char, []
        for k in [k for k, ids in enumerate(out) if ids is None]:
            w = words[k]
            ids = self.former.get(w)
            if ids is None:
                text = w.decode()
                # a space and letters are one piece for the model; all else is split by the tokenizer
                if not text.removeprefix(" ").isalpha():
                    rest.append((k, w, text))
                    continue
                ids = array(code, [t.id for t in self.merge(codecs.charmap_decode(w, "strict", self.letters)[0])]).tobytes()
            self.known[w] = out[k] = ids
        for i in range(0, len(rest), 20_000):
            some = rest[i : i + 20_000]
            got = self.tokenizer.encode([text for _, _, text in some], is_pretokenized=True, add_special_tokens=False)
            raw = np.array(got.ids, self.kind).tobytes()
            cut = (np.searchsorted(np.array(got.word_ids, np.int64), np.arange(len(some) + 1)) * self.kind.itemsize).tolist()
            for (k, w, _), x, y in zip(some, cut, cut[1:], strict=False):
                self.known[w] = out[k] = raw[x:y]
        return out

    def _by_word(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        starts = word_starts(data, offsets)
        ends = np.append(starts, len(data))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)]).dictionary_encode()
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        pieces = {}
        if len(starts) and np.diff(ends).max() > LONG:
            pieces = {k: [p.encode() for p in self.find(w.decode())] for k, w in enumerate(distinct) if len(w) > LONG}
            distinct = [w if len(w) <= LONG else b"" for w in distinct]
        found = self._ids(distinct)
        if pieces:
            known = list(set().union(*pieces.values()))
            known = dict(zip(known, self._ids(known), strict=True))
            for k, of in pieces.items():
                found[k] = b"".join(map(known.__getitem__, of))
        raw, places = byte_column(pa.array(found, pa.large_binary()).take(words.indices))
        raw, places = raw.tobytes(), places[np.searchsorted(starts, offsets)].tolist()
        return [raw[x:y] for x, y in zip(places, places[1:], strict=False)]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not self.by_word:
            return [self._library(t or "") + self.end for t in column.to_pylist()]
        data, offsets = byte_column(column)
        out = []
        for i, j in doc_groups(offsets, GROUP):
            out += self._by_word(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for t in self.special:
            for k in np.flatnonzero(pc.match_substring(column, t).fill_null(False)).tolist():
                out[k] = self._library(column[k].as_py())
        return [ids + self.end for ids in out]


# Schemes that Hadoop has its own names for, and those of the same stores in pyarrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def _filesystem(path: str):
    from pyarrow import fs

    scheme, mark, rest = path.partition("://")
    return fs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + mark + rest)


class Writer:
    """One file of frames, index and seek table."""

    def __init__(self, stream, kind: np.dtype):
        import xxhash
        import zstandard

        self.stream, self.kind, self.checksum = stream, kind, xxhash.xxh64_intdigest
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        # doc_id, whether it is null, number of ids, frame, place in the frame
        self.index = [array("q") for _ in range(5)]
        self.parts: list[bytes] = []
        self.size = self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        for column, value in zip(self.index, (doc_id or 0, doc_id is None, n, len(self.frames), self.size // self.kind.itemsize), strict=True):
            column.append(value)
        self.parts.append(ids)
        self.size += len(ids)
        self.tokens += n
        if self.size >= FRAME:
            self._flush()

    def _flush(self) -> None:
        raw = b"".join(self.parts)
        packed = self.zstd.compress(raw)
        self.stream.write(packed)
        self.frames.append((len(packed), len(raw), self.checksum(raw) & 0xFFFFFFFF))
        self.parts, self.size = [], 0

    def close(self) -> None:
        if self.parts:
            self._flush()
        index = self.zstd.compress(self.kind.str.encode().ljust(4) + b"".join(column.tobytes() for column in self.index))
        self.stream.write(np.array([INDEX_MAGIC, len(index)], "<u4").tobytes() + index)
        table = np.array(self.frames, "<u4").reshape(-1, 3).tobytes()
        footer = np.array([len(self.frames)], "<u4").tobytes() + bytes([0x80]) + np.array([FOOTER_MAGIC], "<u4").tobytes()
        self.stream.write(np.array([SEEK_MAGIC, len(table) + 9], "<u4").tobytes() + table + footer)


class Reader:
    """Documents of one file; frames are read and checked when asked for."""

    def __init__(self, path: str):
        import xxhash
        import zstandard

        files, name = _filesystem(path)
        self.file = files.open_input_file(name)
        self.checksum, self.zstd = xxhash.xxh64_intdigest, zstandard.ZstdDecompressor()
        size = self.file.size()
        footer = self.file.read_at(9, size - 9)
        if int.from_bytes(footer[5:], "little") != FOOTER_MAGIC:
            raise ValueError(f"{path}: no seek table")
        n = int.from_bytes(footer[:4], "little")
        self.frames = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.starts = np.append(0, np.cumsum(self.frames[:, 0]))
        magic, length = np.frombuffer(self.file.read_at(8, int(self.starts[-1])), "<u4").tolist()
        if magic != INDEX_MAGIC:
            raise ValueError(f"{path}: no document index")
        index = self.zstd.decompress(self.file.read_at(length, int(self.starts[-1]) + 8))
        self.kind = np.dtype(index[:4].decode().strip())
        self.doc_id, self.is_null, self.n, self.frame, self.place = np.frombuffer(index, np.int64, offset=4).reshape(5, -1)

    def ids_of(self, frame: int) -> np.ndarray:
        packed, size, check = self.frames[frame].tolist()
        raw = self.zstd.decompress(self.file.read_at(packed, int(self.starts[frame])), max_output_size=size)
        if len(raw) != size or self.checksum(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {frame}: checksum differs")
        return np.frombuffer(raw, self.kind)

    def documents(self, wanted: np.ndarray | None = None):
        """(row of the index, ids) of the wanted rows, or of all; each frame is decompressed once."""
        rows = np.arange(len(self.n)) if wanted is None else np.sort(wanted)
        held, ids = -1, None
        for k in rows.tolist():
            if self.frame[k] != held:
                held, ids = int(self.frame[k]), self.ids_of(int(self.frame[k]))
            yield k, ids[self.place[k] : self.place[k] + self.n[k]]


_MANIFEST = "part int, path string, docs long, tokens long"


def write_tokens(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = 0, files: int | None = None, order: str = "doc_id") -> DataFrame:
    """Write the token files of docs(doc_id, text) into `folder` in the order of a column; the manifest: (part, path, docs, tokens)."""
    vocabulary = vocabulary or default_vocabulary()
    if files is None:
        size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
        files = size // FILE_BYTES + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *([F.col(order).alias("_order")] if order != "doc_id" else []))
    by = "doc_id" if order == "doc_id" else "_order"
    # the hash splits rows without or of equal ids
    place = (*dict.fromkeys((by, "doc_id")), F.xxhash64("text"))
    rows = rows.repartitionByRange(files, *place).sortWithinPartitions(*place).select("doc_id", "text")

    def write(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        encoder = writer = stream = None
        for batch in batches:
            if writer is None and len(batch):
                encoder = Encoder.of_worker(vocabulary, end)
                stream = fs.open_output_stream(f"{root}/{name}.tmp")
                writer = Writer(stream, encoder.kind)
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text")), strict=True):
                    writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(f"{root}/{name}.tmp", f"{root}/{name}.tok.zst")
            values = [[task.partitionId()], [f"{folder}/{name}.tok.zst"], [len(writer.index[0])], [writer.tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "path", "docs", "tokens"])

    return materialise(rows.mapInArrow(lambda it: relieved(write(it), "tokens"), _MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    # one row for each file, not for each document
    files = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    files = files.repartition(max(1, manifest.count()))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = Reader(path)
                start = base + np.cumsum(file.n) - file.n
                crc = np.fromiter((zlib.crc32(ids.astype("<u4").tobytes()) for _, ids in file.documents()), np.int64, len(file.n))
                columns = [pa.array(file.doc_id, mask=file.is_null > 0), pa.array(start), pa.array(file.n), pa.array(crc)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("path", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenise(docs: DataFrame, vocabulary: str | None = None, order: str = "doc_id") -> DataFrame:
    """Write token files to the shared folder and return their contents' index."""
    return read_tokens(write_tokens(docs, new_path(docs.sparkSession, "tokens"), vocabulary, order=order))


def op8_token_frames(spark, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum of ids, read back from the files."""
    return tokenise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
