"""Token ids in sorted-string-table shards, keyed by document identifier.

File format (all integers little-endian):

* data blocks: entries in ascending key order.  A key is 17 bytes: 0 or 1 for a null or present
  doc_id, the doc_id as a big-endian signed 64-bit number with its sign bit flipped, and 8 bytes
  that number repeated rows.  An entry is (shared: u8, unshared: u8, value bytes: u32, rest of the
  key, value); ``shared`` bytes are those of the previous key, 0 for a block's first.  A value
  holds the ids as u16 where the block's width is 2, else as u32.  Blocks are compressed with zstd;
* block index: for each block its first key, offset, compressed size, raw size, entries and width;
* Bloom filter over keys' first 9 bytes: u64 words, 10 bits a key, 7 probes;
* footer of 56 bytes: offset and size of index and filter, entries, ids, and a magic number.

A lookup asks the filter, finds the block by binary search in the sparse index, and scans that
block alone.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textnum as X
from .scratch import fresh, written

MAGIC = 0x31_45_52_4F_54_4B_4F_54
BLOCK_BYTES = 1 << 16
_ENTRY = struct.Struct("<BBI")
_INDEX = struct.Struct("<17sQIIIB")
_FOOTER = struct.Struct("<QQQQQQQ")


def key_of(doc_id: int | None, copy: int = 0) -> bytes:
    return (b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", (doc_id + (1 << 63)) & (2**64 - 1))) + struct.pack(">Q", copy)


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else struct.unpack(">Q", key[1:9])[0] - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key[:9], digest_size=16).digest())
    return [((a + i * (b | 1)) & (2**64 - 1)) % bits for i in range(7)]


class ShardWriter:
    """Writes entries in ascending key order to a binary file."""

    def __init__(self, out) -> None:
        self.out, self.at = out, 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.block: list[tuple[bytes, np.ndarray]] = []
        self.held = self.ids = 0
        self.compress = pa.Codec("zstd", compression_level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        self.block.append((key, ids))
        self.held += 4 * len(ids) + 17
        self.ids += len(ids)
        self.keys.append(key[:9])
        if self.held >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if not self.block:
            return
        width = 2 if all(not len(x) or x.max() < 1 << 16 for _, x in self.block) else 4
        parts, before = [], b""
        for key, ids in self.block:
            shared = next((i for i, (x, y) in enumerate(zip(before, key, strict=False)) if x != y), min(len(before), len(key)))
            value = ids.astype("<u2" if width == 2 else "<u4").tobytes()
            parts += [_ENTRY.pack(shared, len(key) - shared, len(value)), key[shared:], value]
            before = key
        raw = b"".join(parts)
        packed = self.compress.compress(raw, asbytes=True)
        self.index.append(_INDEX.pack(self.block[0][0], self.at, len(packed), len(raw), len(self.block), width))
        self._write(packed)
        self.block, self.held = [], 0

    def close(self) -> tuple[int, int]:
        """Write index, filter and footer; gives (entries, ids)."""
        self._flush()
        index_at, index = self.at, b"".join(self.index)
        self._write(index)
        bits = max(64, -(-len(self.keys) * 10 // 64) * 64)
        words = np.zeros(bits // 64, np.uint64)
        for key in self.keys:
            for p in _probes(key, bits):
                words[p >> 6] |= np.uint64(1 << (p & 63))
        filter_at = self.at
        self._write(words.astype("<u8").tobytes())
        self._write(_FOOTER.pack(index_at, len(index), filter_at, bits // 8, len(self.keys), self.ids, MAGIC))
        return len(self.keys), self.ids


class ShardReader:
    """Reads a shard from a random-access file: by key, or all entries in order."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        file.seek(size - _FOOTER.size)
        index_at, index_size, filter_at, filter_size, self.entries, self.ids, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        file.seek(index_at)
        self.index = list(_INDEX.iter_unpack(file.read(index_size)))
        file.seek(filter_at)
        self.filter = np.frombuffer(file.read(filter_size), "<u8")
        self.firsts = [x[0] for x in self.index]
        self.codec = pa.Codec("zstd")

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, size, raw_size, n, width = self.index[i]
        self.file.seek(at)
        raw = self.codec.decompress(self.file.read(size), raw_size, asbytes=True)
        at, key = 0, b""
        for _ in range(n):
            shared, rest, size = _ENTRY.unpack_from(raw, at)
            at += _ENTRY.size
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, np.frombuffer(raw, f"<u{width}", size // width, at).astype(np.uint32)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every row of a document, in order; none if it is not here."""
        bits = len(self.filter) * 64
        low = key_of(doc_id)
        if not self.entries or not all(int(self.filter[p >> 6]) >> (p & 63) & 1 for p in _probes(low, bits)):
            return []
        found = []
        for i in range(max(bisect.bisect_right(self.firsts, low) - 1, 0), len(self.index)):
            if self.firsts[i][:9] > low[:9]:
                break
            found += [ids for key, ids in self._block(i) if key[:9] == low[:9]]
        return found


class Encoder:
    """Encodes texts with a tokenizer file, each distinct stretch once.

    The byte-level splitting pattern never joins across these places, so a stretch may begin there:
    before a space that a non-space follows, where a digit or letter of ASCII meets punctuation or
    white space, and behind a line feed between two of these.  Stretches are encoded by the
    tokenizers library and remembered, at most ``remembered`` of them; they are found by hash and
    compared byte by byte.  A text that holds the literal
    of an added token (``<|endoftext|>``) is encoded whole, as the library sees these before it splits.
    """

    remembered = 1 << 20

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.literals = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        """Two sorted levels of (hash, number of stretch): new ones join the small one, which is merged into the large one now and then."""
        self.levels = [(np.zeros(0, X.U64), np.zeros(0, np.int64)) for _ in range(2)]
        self.ids, self.texts = Pool(np.uint32), Pool(np.uint8)
        self.n = 0

    def _find(self, distinct: np.ndarray) -> np.ndarray:
        """Number of each stretch, -1 if it is not known."""
        number = np.full(len(distinct), -1, np.int64)
        for hashes, numbers in self.levels:
            if len(hashes):
                place = np.minimum(np.searchsorted(hashes, distinct), len(hashes) - 1)
                hit = hashes[place] == distinct
                number[hit] = numbers[place[hit]]
        return number

    def _learn(self, hashes: np.ndarray, texts: list[bytes]) -> np.ndarray:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids.add(np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)
        self.texts.add(np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts)))
        numbers = np.arange(self.n, self.n + len(ids))
        self.n += len(ids)
        small = self._merged(self.levels[1], (hashes, numbers))
        if len(small[0]) * 4 > len(self.levels[0][0]):
            self.levels = [self._merged(self.levels[0], small), (hashes[:0], numbers[:0])]
        else:
            self.levels[1] = small
        return numbers

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        hashes = np.concatenate([a[0], b[0]])
        order = np.argsort(hashes, kind="stable")
        return hashes[order], np.concatenate([a[1], b[1]])[order]

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The texts that hold an added token's literal."""
        raw, found = data.tobytes(), set()
        for literal in self.literals:
            at = raw.find(literal)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, side="right"))
                if at + len(literal) <= offsets[text]:
                    found.add(text - 1)
                    at = raw.find(literal, int(offsets[text]))
                else:
                    at = raw.find(literal, at + 1)
        return np.array(sorted(found), np.int64)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, id offsets of the texts)."""
        whole = self._whole(data, offsets)
        if not len(whole):
            return self._stretched(data, offsets)
        sizes = np.diff(offsets)
        rest = np.ones(len(sizes), bool)
        rest[whole] = False
        ids, at = self._stretched(data[np.repeat(rest, sizes)], np.concatenate([[0], np.cumsum(np.where(rest, sizes, 0))]))
        texts = [data[offsets[i] : offsets[i + 1]].tobytes().decode() for i in whole]
        parts, last = [], 0
        for i, text in zip(whole.tolist(), texts, strict=True):
            parts += [ids[at[last] : at[i]], np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)]
            last = i
        counts = np.diff(at)
        counts[whole] = [len(x) for x in parts[1::2]]
        return np.concatenate([*parts, ids[at[last] :]]), np.concatenate([[0], np.cumsum(counts)])

    def _stretched(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without such literals; a long text goes in pieces between sure token boundaries."""
        if len(data) <= 2 * X.BLOCK:
            return self._piece(data, offsets)
        ids, at = [np.zeros(0, np.uint32)], np.zeros(len(offsets), np.int64)
        for i in range(len(offsets) - 1):
            begin = offsets[i]
            while begin < offsets[i + 1]:
                end = min(begin + X.BLOCK, offsets[i + 1])
                while end < offsets[i + 1]:
                    low = max(begin, end - (1 << 16))
                    places = np.flatnonzero(_cuts(data[low : end + 2])[2:-1]) + low + 2
                    if len(places):
                        end = places[-1]
                        break
                    end = min(end + (1 << 16) - 4, offsets[i + 1])
                ids.append(self._piece(data[begin:end], np.array([0, end - begin]))[0])
                at[i + 1] += len(ids[-1])
                begin = end
        return np.concatenate(ids), np.cumsum(at)

    def _piece(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = _cuts(data)
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        hashes = X.word_hashes(data, starts, ends)
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        number = self._find(distinct)
        new = np.flatnonzero(number < 0)
        if len(new):
            if self.n + len(new) > self.remembered:
                self._clear()
                new = np.arange(len(distinct))
            raw = data.tobytes()
            number[new] = self._learn(distinct[new], [raw[starts[i] : ends[i]] for i in first[new]])
        number = number[which]
        known, sizes = self.texts.of(number)
        if len(known) != n or not np.array_equal(known, data):  # two stretches of one hash: the library encodes the texts whole
            texts = [data[a:b].tobytes().decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array(list(chain.from_iterable(lists)), np.uint32), np.cumsum([0, *map(len, lists)])
        ids, sizes = self.ids.of(number)
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)]


class Pool:
    """Numbered lists of numbers in one growing array."""

    def __init__(self, kind: type) -> None:
        self.starts, self.flat, self.n = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, kind), 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        at = int(self.starts[self.n])
        if self.n + len(sizes) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(max(len(self.starts), len(sizes) + 1), np.int64)])
        if at + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(values)), self.flat.dtype)])
        self.flat[at : at + len(values)] = values
        self.starts[self.n + 1 : self.n + 1 + len(sizes)] = at + np.cumsum(sizes)
        self.n += len(sizes)

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the lists of these numbers behind one another, their sizes)."""
        begin = self.starts[numbers]
        sizes = self.starts[numbers + 1] - begin
        end = np.cumsum(sizes)
        source = np.arange(end[-1] if len(end) else 0)
        source += np.repeat(begin - end + sizes, sizes)
        return self.flat[source], sizes


def _cuts(data: np.ndarray) -> np.ndarray:
    """The bytes at which a stretch may begin."""
    kind = _KIND[data]
    cut = np.zeros(len(data), bool)
    cut[1:] = _MEETS[kind[:-1], kind[1:]]
    cut[2:] |= (kind[1:-1] == 3) & _WORDLIKE[kind[:-2]] & _WORDLIKE[kind[2:]]
    cut[:-1] |= (data[:-1] == 0x20) & _FOLLOWS[data[1:]]
    return cut


#: Bytes behind a space that begin no white-space character: C2, E1, E2 and E3 may.
_FOLLOWS = np.ones(256, bool)
_FOLLOWS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x1F, 0x20, 0xC2, 0xE1, 0xE2, 0xE3]] = False
#: Kinds of bytes: 0 others, 1 letters and digits, 2 punctuation, 3 line feed.
_KIND = np.zeros(256, np.uint8)
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2
_KIND[0x0A] = 3
#: Whether a stretch begins at a byte of the second kind behind one of the first.
_MEETS = np.zeros((4, 4), bool)
_MEETS[1, 2] = _MEETS[1, 3] = _MEETS[2, 3] = True
_WORDLIKE = np.array([False, True, True, False])

_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _encoder(path: str) -> Encoder:
    """One encoder a process: its memory of stretches outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Ids in a shard, about: a task begins another one beyond.
SHARD_IDS = 1 << 23


def _write_shards(folder: str, tokenizer: str, end_id: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        encode, end = _encoder(tokenizer), np.array([end_id], np.uint32)
        part, number, shard, last, copy = TaskContext.get().partitionId(), 0, None, None, 0

        def closed() -> pa.RecordBatch:
            entries, total = shard.close()
            file.close()
            system.move(f"{name}.part", name)
            uri = f"{folder.rstrip('/')}/{name.rsplit('/', 1)[1]}"
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([number], pa.int64()), *(pa.array([x], pa.int64()) for x in (first, last)), pa.array([uri]), *(pa.array([x], pa.int64()) for x in (entries, total))], names=["part", "number", "first_id", "last_id", "uri", "entries", "ids"])

        for batch in X.slices(batches):
            ids, at = encode(*X.column_bytes(batch.column(1)))
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                if shard is not None and shard.ids >= most:
                    yield closed()
                    number, shard = number + 1, None
                if shard is None:
                    # Written under a name of this attempt and moved: a task that runs twice leaves whole files only.
                    first, name = doc_id, f"{base}/{uuid.uuid4().hex}.sst"
                    system.create_dir(base, recursive=True)
                    file = system.open_output_stream(f"{name}.part")
                    shard = ShardWriter(file)
                copy = copy + 1 if shard.keys and doc_id == last else 0
                last = doc_id
                shard.add(key_of(doc_id, copy), np.concatenate([ids[at[i] : at[i + 1]], end]))
        if shard is not None:
            yield closed()

    return run


def write_store(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 0, shard_rows: int = 8_192, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encode every text, append end_id, and write shards in ascending doc_id order; gives the manifest.

    The manifest has a row for each shard: part, number (the order of shards), first_id, last_id, uri,
    entries, ids.  A part is a range of documents of about ``shard_rows``; beyond ``shard_ids`` it goes
    on in another shard.  A null or empty text is end_id alone; very long texts are encoded whole, in
    pieces between sure token boundaries.  Rows with a null doc_id come first; rows that repeat an id
    are entries of the same key, told apart by their number in the shard, in the order of their texts'
    hashes: many of them are spread over several parts.  An empty table gives no shards; other columns
    are ignored, whatever their names.  ``folder`` is a URI that pyarrow opens (file, hdfs, s3 ...).
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = max(1, -(-slim.count() // shard_rows))
    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text"), F.asc_nulls_first("text")]
    # Rows that are alike may change places, so their ranges are cut by their places in the input.
    dealt = slim.repartitionByRange(shards, order[0], order[1], F.monotonically_increasing_id()).sortWithinPartitions(*order)
    kind = "part long, number long, first_id long, last_id long, uri string, entries long, ids long"
    return written(dealt.mapInArrow(_write_shards(folder, tokenizer or default_tokenizer(), end_id, shard_ids), kind), "manifest")


#: Parts whose shards are summed up together.
BLOCK_PARTS = 1024


def placed(manifest: DataFrame) -> DataFrame:
    """(uri, start): of each shard, the ids of all shards before it, by sums of blocks of parts and within them."""
    shards = manifest.withColumn("block", F.floor(F.col("part") / BLOCK_PARTS))
    before = lambda window: F.sum("ids").over(window.rowsBetween(Window.unboundedPreceding, -1))
    blocks = shards.groupBy("block").agg(F.sum("ids").alias("ids"))  # a row for some thousand shards
    blocks = blocks.select("block", F.coalesce(before(Window.orderBy("block")), F.lit(0)).alias("base"))
    inner = shards.select("block", "uri", F.coalesce(before(Window.partitionBy("block").orderBy("part", "number")), F.lit(0)).alias("inside"))
    return inner.join(blocks, "block").select("uri", (F.col("base") + F.col("inside")).alias("start"))


def read_store(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every entry of the shards, start counting ids over all shards in order."""
    shards, cores = manifest.count(), manifest.sparkSession.sparkContext.defaultParallelism

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = fs.FileSystem.from_uri(uri)
                with system.open_input_file(path) as file:
                    out: list[list] = [[], [], [], []]
                    for key, ids in ShardReader(file):
                        for column, value in zip(out, (id_of(key), start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            column.append(value)
                        start += len(ids)
                        if len(out[0]) == 8192:
                            yield _entries(out)
                            out = [[], [], [], []]
                    yield _entries(out)

    tasks = max(1, min(shards, max(4 * cores, shards // 16)))  # a task reads some shards
    return placed(manifest).repartition(tasks, "uri").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _entries(out: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def lookup(manifest_rows: list, doc_id: int | None) -> list[np.ndarray]:
    """The ids of a document from the shards of collected manifest rows (a binary search each)."""
    found = []
    for r in manifest_rows:
        if doc_id is None or (r.first_id is None or r.first_id <= doc_id) and (r.last_id is not None and doc_id <= r.last_id):
            system, path = fs.FileSystem.from_uri(r.uri)
            with system.open_input_file(path) as file:
                found += ShardReader(file).get(doc_id)
    return found


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_store(write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh(spark, "tokens")))
