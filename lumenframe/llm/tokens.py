"""Token ids with a public byte-level BPE vocabulary, and length-delimited binary records of them.

File format, one data file and one index file per shard, little-endian:

* data: records of  length (u64), masked crc32 of those 8 bytes (u32), payload, masked crc32 of the payload (u32);
  the payload is the document's id (i64) and its token ids (u16; u32 where the vocabulary has more than 65,536 ids).
  The mask turns a crc right by 15 bits and adds 0xA282EAD8, so that a checksum of checksummed data differs from it.
* index: for each record its place in the data file (u64), for reads in any order.

Shards hold ascending ranges of document ids. A shard's files get a name of their own for each attempt; only the
attempt whose manifest row Spark keeps is read, so a lost or repeated task leaves nothing that counts.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.llm.arrays import raw_bytes
from lumenframe.llm.common import table
from lumenframe.session import materialize, new_path

MASK_DELTA = 0xA282EAD8
#: Bytes of a record beside its ids: length, two checksums, the document's id.
FRAME_BYTES = 24
#: Bytes of text that are coded at once, for which some thirty times as many are needed; units that a task keeps the ids of.
TEXT_BYTES, UNITS = 2 << 20, 400_000


#: What a byte is to the cuts of units: an ASCII letter, any ASCII byte, white space or a control character, and a first
#: byte of a character that surely isn't white space.
_LETTER, _ASCII, _BLANK, _SOLID = 1, 2, 4, 8
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] |= _LETTER
_KIND[:128] |= _ASCII
_KIND[:33] |= _BLANK
_KIND[33:] |= _SOLID
_KIND[[0xC2, 0xE1, 0xE2, 0xE3]] &= ~np.uint8(_SOLID)


def unit_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where units begin in texts that begin at the places at[:-1] of data and end at at[-1].

    A byte-level BPE never merges across these places: where an ASCII letter ends before another ASCII character, where
    white space begins after another ASCII character, and before a single space that other than white space follows.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data):
        kind = _KIND[data]
        before, here = kind[:-1], kind[1:]
        ends = (before & _LETTER != 0) & (here & (_LETTER | _ASCII) == _ASCII)
        blank = (here & _BLANK != 0) & (before & (_ASCII | _BLANK) == _ASCII)
        cut[1:-1] = ends | blank
        space = np.append((data[:-1] == 32) & (here & _SOLID != 0), False)
        space[at[1:][at[1:] > 0] - 1] = False  # what follows is another text
        cut[:-1] |= space
    cut[at] = True
    cut[len(data)] = False
    return np.flatnonzero(cut)


class UnitTokenizer:
    """Token ids of many texts at once. Each distinct unit of a batch is looked up once; new ones go to the tokenizer.

    The store of units is emptied when it has max_units. Strings of added tokens in a text are these tokens, as the
    tokenizer itself has it; texts are cut around them.
    """

    def __init__(self, path: str, max_units: int = UNITS, wide: bool | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        split = json.loads(self.tokenizer.to_str())["pre_tokenizer"] or {}
        added = self.tokenizer.get_added_tokens_decoder().values()
        if split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space") or any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added):
            raise ValueError("only byte-level tokenizers without a prefix space and with plain added tokens have such units")
        self.added = [t.content.encode() for t in added]
        self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():  # a character stands for a byte
            self.bytes_of[i] = len(token)
        self.max_units = max_units
        wide = self.tokenizer.get_vocab_size() > 1 << 16 if wide is None else wide
        self.dtype = np.dtype("<u4" if wide else "<u2")
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.begin = np.zeros(0, self.dtype), np.zeros(1, np.int64)

    def _learn(self, units: list[bytes]) -> None:
        """Code new units: those that begin with a space many in one string, as none merges with the one before it."""
        spaced = [u for u in units if u[:1] == b" " and len(u) > 1 and _KIND[u[1]] & _SOLID]
        others = [u for u in units if not (u[:1] == b" " and len(u) > 1 and _KIND[u[1]] & _SOLID)]
        for u in [*spaced, *others]:
            self.number[u] = len(self.number)
        ids, ends = [self.ids], [self.begin]
        for i in range(0, len(spaced), 2_000):
            some = spaced[i : i + 2_000]
            coded = np.array(self.tokenizer.encode(b"".join(some).decode(), add_special_tokens=False).ids, self.dtype)
            at = np.cumsum(self.bytes_of[coded])
            last = np.searchsorted(at, np.cumsum(np.fromiter(map(len, some), np.int64, len(some))))
            ids.append(coded)
            ends.append(ends[-1][-1] + last + 1)
        for i in range(0, len(others), 20_000):
            coded = [e.ids for e in self.tokenizer.encode_batch_fast([u.decode() for u in others[i : i + 20_000]], add_special_tokens=False)]
            n = np.fromiter(map(len, coded), np.int64, len(coded))
            ids.append(np.fromiter(chain.from_iterable(coded), self.dtype, int(n.sum())))
            ends.append(ends[-1][-1] + np.cumsum(n))
        self.ids, self.begin = np.concatenate(ids), np.concatenate(ends)

    def _added(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Starts and ends of added tokens within texts."""
        out, raw = [np.zeros((0, 2), np.int64)], data.tobytes() if self.added else b""
        for token in self.added:
            i = raw.find(token)
            while i >= 0:
                if np.searchsorted(at, i, side="right") == np.searchsorted(at, i + len(token), side="left"):
                    out.append(np.array([[i, i + len(token)]]))
                    i += len(token) - 1
                i = raw.find(token, i + 1)
        return np.concatenate(out)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string array (null: none), without special tokens, and the place where each text's begin, and the last one's end."""
        data, at = raw_bytes(column)
        own = self._added(data, at)
        starts = unit_starts(data, np.unique(np.append(at, own.ravel())))
        if len(own):  # an added token is one unit
            inside = np.zeros(len(data) + 1, np.int32)
            np.add.at(inside, own[:, 0] + 1, 1)
            np.add.at(inside, own[:, 1], -1)
            starts = starts[np.cumsum(inside)[starts] == 0]
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(at), np.int64)
        offsets = pa.py_buffer(np.append(starts, len(data)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, offsets, pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        units = coded.dictionary.to_pylist()
        new = [u for u in units if u not in self.number]
        if len(self.number) + len(new) > self.max_units:
            self._clear()
            new = units
        self._learn(new)
        number = np.fromiter(map(self.number.__getitem__, units), np.int64, len(units))[coded.indices.to_numpy()]
        begin, n = self.begin[number], np.diff(self.begin)[number]
        ends = np.append(0, np.cumsum(n))
        ids = self.ids[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], n)]
        return ids, ends[np.searchsorted(starts, at)]


def with_end(ids: np.ndarray, at: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many texts with end_id after each, and their places."""
    n = len(at) - 1
    own = np.zeros(len(ids) + n, bool)
    at = at + np.arange(n + 1)
    own[at[1:] - 1] = True
    out = np.full(len(own), end_id, ids.dtype)
    out[~own] = ids
    return out, at


_TOKENIZERS: dict[str, UnitTokenizer] = {}


def tokenizer(path: str, max_units: int = UNITS) -> UnitTokenizer:
    """The worker process's tokenizer of this file."""
    if path not in _TOKENIZERS:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _TOKENIZERS[path] = UnitTokenizer(path)
    _TOKENIZERS[path].max_units = max_units
    return _TOKENIZERS[path]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of an Arrow batch of about most bytes each (one row at least). After the last one Arrow gives back what it holds in reserve."""
    n = max(1, int(batch.num_rows * most / max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, n):
        yield batch.slice(i, n)
    pa.default_memory_pool().release_unused()


def masked(crc: int) -> int:
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record of the data file."""
    head = len(payload).to_bytes(8, "little")
    return b"".join((head, masked(zlib.crc32(head)).to_bytes(4, "little"), payload, masked(zlib.crc32(payload)).to_bytes(4, "little")))


def read_frame(f, at: int | None = None) -> bytes | None:
    """The payload of the record at this place, or of the next one; None at the end. Checks both checksums."""
    if at is not None:
        f.seek(at)
    head = f.read(12)
    if not head:
        return None
    n, crc = int.from_bytes(head[:8], "little"), int.from_bytes(head[8:], "little")
    if len(head) < 12 or crc != masked(zlib.crc32(head[:8])):
        raise ValueError("damaged record length")
    payload, crc = f.read(n), int.from_bytes(f.read(4), "little")
    if len(payload) < n or crc != masked(zlib.crc32(payload)):
        raise ValueError("damaged record")
    return payload


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


MANIFEST = "shard int, data string, index string, first_id long, docs long, ids long, bytes long"


def write_records(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> DataFrame:
    """Tokenize texts, append end_id, and write shards of records below path in ascending order of ids.

    Returns the manifest, one row per shard that has documents: shard (ascending as their ids), data and index (files), first_id, docs, ids,
    bytes. Null texts count as empty: their record has the end id only. Null ids come first and are written as the
    smallest long; rows that repeat an id are all written, ordered by a hash of the text, so that many of them aren't one
    shard. Strings of the tokenizer's added tokens are these tokens. An empty table gives an empty manifest; other
    columns aren't read.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sized = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(text_col).alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, shard = tokenizer(tokenizer_file), TaskContext.get().partitionId()
        name = f"{path}/shard-{shard:06d}-{uuid.uuid4().hex}"
        out, places, at, first, ids = None, [], 0, None, 0
        for whole in batches:
            for b in slices(whole, TEXT_BYTES):
                keys = b.column(0).to_numpy()
                if out is None and len(keys):
                    filesystem, base = _open(name)
                    filesystem.create_dir(base.rsplit("/", 1)[0], recursive=True)
                    out, first = filesystem.open_output_stream(base + ".data"), int(keys[0])
                coded, ends = with_end(*tok.encode(b.column(1)), end_id)
                raw, own = coded.tobytes(), (ends * tok.dtype.itemsize).tolist()
                heads = keys.astype("<i8").tobytes()
                for i in range(len(keys)):
                    record = frame(heads[8 * i : 8 * i + 8] + raw[own[i] : own[i + 1]])
                    out.write(record)
                    places.append(at)
                    at += len(record)
                ids += len(coded)
        if out is not None:
            out.close()
            with filesystem.open_output_stream(base + ".index") as f:
                f.write(np.array(places, "<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "data": [name + ".data"], "index": [name + ".index"], "first_id": [first], "docs": [len(places)], "ids": [ids], "bytes": [at]})

    ordered = sized.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    return materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def read_records(manifest: DataFrame, wide: bool = False, block: int = 4096, shuffle_seed: int | None = None) -> DataFrame:
    """Read the files that a manifest names: one row per record.

    Returns doc_id, start (ids of all records before it), n_tokens, ids_crc32 (unsigned, of the ids as little-endian
    unsigned 32-bit integers). Each block of records is found through the index by a task of its own, in any order; with
    shuffle_seed, blocks are dealt out at random and the records of a block are read in random order. An empty manifest
    gives an empty result.
    """
    starts = manifest.withColumn("before", F.coalesce(F.sum("ids").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    dtype = np.dtype("<u4" if wide else "<u2")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, data = _open(row["data"])
                with filesystem.open_input_file(_open(row["index"])[1]) as f:
                    f.seek(8 * row["first"])
                    places = np.frombuffer(f.read(8 * min(block, row["docs"] - row["first"])), "<u8").astype(np.int64)
                # A record has 24 bytes beside its ids, so its place tells how many ids stand before it.
                start = row["before"] + (places - FRAME_BYTES * (row["first"] + np.arange(len(places)))) // dtype.itemsize
                order = range(len(places)) if shuffle_seed is None else np.random.default_rng([shuffle_seed, row["first"]]).permutation(len(places)).tolist()
                out = []
                with filesystem.open_input_file(data) as raw:
                    if shuffle_seed is None:  # in order: read ahead
                        raw.seek(int(places[0]))
                        raw = pa.BufferedInputStream(raw, 1 << 20)
                    for i in order:
                        payload = read_frame(raw, None if shuffle_seed is None else int(places[i]))
                        n = (len(payload) - 8) // dtype.itemsize
                        out.append((int.from_bytes(payload[:8], "little", signed=True), int(start[i]), n, zlib.crc32(np.frombuffer(payload, dtype, offset=8).astype("<u4").tobytes())))
                cols = list(zip(*out, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    blocks = starts.where("docs > 0").select("data", "index", "before", "docs", F.explode(F.sequence(F.lit(0).cast("long"), F.col("docs") - 1, F.lit(block).cast("long"))).alias("first"))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    deal = [F.col("data"), F.col("first")] if shuffle_seed is None else [F.xxhash64(F.lit(shuffle_seed), "data", "first")]
    return blocks.repartition(n, *deal).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_records(table(spark, sf_dir, "documents"), new_path(spark, "token-records"), vocabulary())
    return read_records(manifest)
