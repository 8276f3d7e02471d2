"""Token ids in raw binary files, with a minimal perfect hash index from document keys to their place.

Files, all little-endian:

* ``data/part-<n>.ids``: the ids of a range of documents in order of the keys, nothing
  else; 16 bits each where every id of the tokenizer fits, else 32.
* ``index/part-<n>.mph``: the index of a range of key hashes. A header of 64-bit
  integers: number of tables and of keys. Then for every table, and once more at the
  end, its first slot and its first pilot (64 bits each), every pilot (32 bits), and
  for every slot a record of 24 bytes: fingerprint (32 bits), file (32 bits), first
  id (64 bits), number of ids (64 bits).

Index: hash and displace. Of a key's 128-bit hash the top bits give the file, the
next ones the table, and the low half the group and, with the group's pilot, the
slot. Tables have ``TABLE`` keys on average and groups ``GROUP``, so that pilots are
found by few trials with no slot left over. A look-up reads one table entry, one
pilot and one record, whatever the number of keys, and compares the stored
fingerprint, so an unknown key is refused but for one in 2^32.

Documents are dealt to files by ranges of their keys and sorted there, hashes by
their top bits, which are even. Tasks write under a name of their own and rename at
the end, so repeated tasks are harmless. Files are written and read with pyarrow's
file systems, so the folder may be on any store that they know.

Null and empty texts hold the end id alone. Rows without a key come first in the
files and are not in the index. Keys have to be different: repeated keys are an
error, since a keyed file can hold one text for a key only, unless their texts are
equal, when they are written once. Empty tables give no files. Other columns are
not read.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from netlens.llm.common import cut_lineage, small_batches

TABLE = 128
GROUP = 4
FILE_KEYS = 500_000
RECORD = np.dtype([("print", "<u4"), ("file", "<u4"), ("start", "<u8"), ("length", "<u8")])
CACHE = 1_200_000
#: Texts of other characters go to the tokenizer as a whole; these are split as it does, many texts at once.
_OTHER = re.compile("[^\\t\\n\\r -~À-ÖØ-öø-ɏ‘’“”–—…«»¿¡]")
_SPACE, _LETTER, _DIGIT, _SIGN, _REST = range(5)
_KIND = np.full(256, _SIGN, np.int8)
_KIND[[9, 10, 13, 32]] = _SPACE
_KIND[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[0x80:0xC0] = _REST  # of a character that began before
#: Endings that are words of their own after an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


# -- encoding -----------------------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library.

    Its words are encoded once each and kept in a bounded cache.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        spec = json.loads(self.tokenizer.to_str())
        split = spec.get("pre_tokenizer") or {}
        self.by_word = (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) == ("ByteLevel", True, False)
        self.by_word &= spec.get("normalizer") is None
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.cache: dict[bytes, bytes] = {}

    def _bytes(self, ids: list[int]) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, ``width`` bytes each."""
        whole = [k for k, t in enumerate(texts) if not self.by_word or _OTHER.search(t) or any(s in t for s in self.special)]
        found = self.tokenizer.encode_batch_fast([texts[k] for k in whole], add_special_tokens=False)
        out = [b""] * len(texts)
        for k, e in zip(whole, found, strict=True):
            out[k] = self._bytes(e.ids)
        plain = sorted(set(range(len(texts))) - set(whole))
        for k, ids in zip(plain, self._plain([texts[k].encode() for k in plain]), strict=True):
            out[k] = ids
        return out

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts of plain characters, through the table of their different words."""
        raw = b"".join(texts)
        if not raw:
            return [b""] * len(texts)
        ends = np.cumsum([len(t) for t in texts])
        cuts = np.append(word_starts(raw, ends - [len(t) for t in texts]), len(raw)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(raw)])
        coded = words.dictionary_encode()
        code = coded.indices.to_numpy()
        if len(self.cache) > CACHE:
            self.cache.clear()
        different, cache = coded.dictionary.to_pylist(), self.cache
        new = [w for w in different if w not in cache]
        encoded = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        for w, e in zip(new, encoded, strict=True):
            cache[w] = self._bytes(e.ids)
        parts = [cache[w] for w in different]
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // self.width
        flat = np.frombuffer(b"".join(parts), f"<u{self.width}")
        n = size[code]
        total = np.cumsum(n)
        ids = flat[np.repeat((np.cumsum(size) - size)[code] - (total - n), n) + np.arange(total[-1])]
        last = np.append(0, total)[np.searchsorted(cuts, ends)]
        return [ids[a:b].tobytes() for a, b in zip(np.append(0, last[:-1]), last, strict=True)]


def word_starts(raw: bytes, texts: np.ndarray) -> np.ndarray:
    """Where the tokenizer's words begin in plain texts that stand one after the other, from the positions ``texts``.

    A word is a run of letters, of digits or of other signs, with the space before it; white space before that space
    is a word, and so is an ending after an apostrophe.
    """
    b = np.frombuffer(raw, np.uint8)
    kind = _KIND[b]
    for _ in range(2):
        rest = np.flatnonzero(kind == _REST)
        kind[rest] = kind[rest - 1]
    first = np.zeros(len(b) + 1, bool)  # of a text
    first[texts] = True
    first = first[:-1]
    white = kind == _SPACE
    change = np.append(True, kind[1:] != kind[:-1]) | first
    after_white = np.append(False, white[:-1]) & ~white & ~first
    space_before = np.append(False, b[:-1] == 32) & after_white
    start = change & ~space_before
    start[:-1] |= after_white[1:]
    quotes = np.flatnonzero((b == 39) & change & ~space_before)
    for q in quotes[np.isin(b[np.minimum(quotes + 1, len(b) - 1)], list(b"strvmld"))].tolist():
        for ending in _ENDINGS:
            end = q + 1 + len(ending)
            if raw[q + 1 : end] == ending.encode() and not first[q + 1 : end].any():
                start[q + 1] = False
                if end < len(b) and not white[end]:
                    start[end] = True
                break
    return np.flatnonzero(start)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder in each Python worker; workers are reused, and it keeps its cache."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# -- index --------------------------------------------------------------------------------------------------------


def key_hash(keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """High and low half of each key's hash, and its fingerprint."""
    whole = [xxhash.xxh3_128_intdigest(k.encode("utf-8", "surrogatepass")) for k in keys]
    high = np.fromiter((h >> 64 for h in whole), np.uint64, len(whole))
    low = np.fromiter((h & (1 << 64) - 1 for h in whole), np.uint64, len(whole))
    return high, low, (_mixed(high ^ low, np.uint64(0x5851F42D)) >> np.uint64(32)).astype(np.uint32)


def _mixed(low: np.ndarray, pilot: np.ndarray) -> np.ndarray:
    z = (low ^ (pilot * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(32))


def file_of(high: np.ndarray, files: int) -> np.ndarray:
    return ((high >> np.uint64(32)) * np.uint64(files) >> np.uint64(32)).astype(np.int64)


def _table_of(high: np.ndarray, tables: int) -> np.ndarray:
    return ((high & np.uint64(0xFFFFFFFF)) * np.uint64(tables) >> np.uint64(32)).astype(np.int64)


def _groups(keys: np.ndarray | int):
    return -(-keys // GROUP)


def _pilots(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pilots of a table's groups, and the slot of each key; every slot is taken."""
    n = len(low)
    pilots, slots = np.zeros(_groups(n), np.uint32), np.zeros(n, np.int64)
    group = (low % np.uint64(len(pilots))).astype(np.int64)
    free = np.ones(n, bool)
    order = np.argsort(group, kind="stable")
    cuts = np.searchsorted(group[order], np.arange(len(pilots) + 1))
    for g in np.argsort(-np.diff(cuts), kind="stable"):  # large groups first
        mine = order[cuts[g] : cuts[g + 1]]
        for start in range(0, 1 << 24, 512):
            if not len(mine):
                break
            at = (_mixed(low[mine][None], np.arange(start, start + 512, dtype=np.uint64)[:, None]) % np.uint64(n)).astype(np.int64)
            fits = free[at].all(1)
            if len(mine) > 1:
                fits &= (np.diff(np.sort(at, 1), axis=1) > 0).all(1)
            if fits.any():
                k = int(fits.argmax())
                pilots[g], slots[mine] = start + k, at[k]
                free[at[k]] = False
                break
        else:
            raise ValueError("two keys have the same hash, or a key is repeated with another text")
    return pilots, slots


def build_index(high: np.ndarray, low: np.ndarray, records: np.ndarray) -> bytes:
    """An index file of keys that fall into it."""
    tables = max(1, len(high) // TABLE)
    table = _table_of(high, tables)
    order = np.argsort(table, kind="stable")
    cuts = np.searchsorted(table[order], np.arange(tables + 1))
    starts = np.cumsum(np.append(0, _groups(np.diff(cuts))))
    pilots, slots = [np.empty(0, np.uint32)], np.empty(len(high), np.int64)
    for t in range(tables):
        mine = order[cuts[t] : cuts[t + 1]]
        if len(mine):
            p, at = _pilots(low[mine])
            pilots.append(p)
            slots[mine] = cuts[t] + at
    placed = np.zeros(len(high), RECORD)
    placed[slots] = records
    head = np.array([tables, len(high)], "<u8")
    return b"".join(x.tobytes() for x in (head, np.stack([cuts, starts], 1).astype("<u8"), np.concatenate(pilots).astype("<u4"), placed))


class IndexFile:
    """Look-ups in the bytes of an index file."""

    def __init__(self, raw: bytes):
        self.tables, keys = (int(x) for x in np.frombuffer(raw, "<u8", 2))
        self.directory = np.frombuffer(raw, "<u8", 2 * (self.tables + 1), 16).reshape(-1, 2).astype(np.int64)
        at = 16 + 16 * (self.tables + 1)
        n = int(self.directory[-1, 1])
        self.pilots = np.frombuffer(raw, "<u4", n, at)
        self.records = np.frombuffer(raw, RECORD, keys, at + 4 * n)

    def look_up(self, high: np.ndarray, low: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Records, and whether each is the key's."""
        table = _table_of(high, self.tables)
        first, keys = self.directory[table, 0], np.diff(self.directory[:, 0])[table]
        known = keys > 0
        n = np.maximum(keys, 1)
        group = (low % _groups(n).astype(np.uint64)).astype(np.int64)
        pilot = self.pilots[np.where(known, self.directory[table, 1] + group, 0)] if len(self.pilots) else np.zeros(len(low), np.uint32)
        slot = first + (_mixed(low, pilot.astype(np.uint64)) % n.astype(np.uint64)).astype(np.int64)
        if not len(self.records):
            return np.zeros(len(low), RECORD), np.zeros(len(low), bool)
        found = self.records[np.where(known, slot, 0)]
        return found, known & (found["print"] == prints)


# -- files --------------------------------------------------------------------------------------------------------


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _publish(fs: pafs.FileSystem, temp: str, final: str) -> None:
    """Rename; where another attempt of the task was first, its file is the same."""
    try:
        fs.move(temp, final)
    except OSError:
        if fs.get_file_info(final).type != pafs.FileType.File:
            raise
        fs.delete_file(temp)


def data_name(n: int) -> str:
    return f"data/part-{n:06d}.ids"


def index_name(n: int) -> str:
    return f"index/part-{n:06d}.mph"


@dataclass(frozen=True)
class TokenFiles:
    """A folder of token files: how many files of each kind, and the documents' places (key, file, start, length)."""

    folder: str
    width: int
    index_files: int
    places: DataFrame


def write(docs: DataFrame, tokenizer: str, folder: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0) -> TokenFiles:
    """Encode the texts and write data and index files; ``end_id`` ends each document."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"))
    fs, path = _open(folder)
    for sub in ("data", "index"):
        fs.create_dir(f"{path}/{sub}", recursive=True)
    width = encoder(tokenizer).width
    if end_id >= 1 << 8 * width:
        raise ValueError("the end id does not fit the width of the ids")
    end = np.array([end_id], f"<u{width}").tobytes()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        fs, path = _open(folder)
        n, start, last, out = TaskContext.get().partitionId(), 0, None, None
        temp = f"{path}/data/.{uuid.uuid4().hex}"
        for batch in small_batches(batches, 1, 1 << 22):
            out = out or fs.open_output_stream(temp)
            keys, texts = (c.to_pylist() for c in batch.columns)
            fresh_rows = []
            for k, t in zip(keys, texts, strict=True):
                if k is not None and last is not None and last[0] == k:
                    if last[1] != t:
                        raise ValueError(f"key {k} has two texts")
                    continue
                last = (k, t)
                fresh_rows.append((k, t or ""))
            lengths = []
            for ids in own.encode([t for _, t in fresh_rows]):
                out.write(ids)
                out.write(end)
                lengths.append(len(ids) // width + 1)
            starts = start + np.cumsum([0, *lengths])
            start = int(starts[-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in fresh_rows], batch.schema.field(0).type), pa.array([n] * len(lengths), pa.int32()),
                 pa.array(starts[:-1], pa.int64()), pa.array(lengths, pa.int64())],
                names=["key", "file", "start", "length"],
            )
        if out:
            out.close()
            _publish(fs, temp, f"{path}/{data_name(n)}")

    kind = dict(rows.dtypes)["key"]
    dealt = rows.repartitionByRange("key").sortWithinPartitions("key", F.xxhash64("t"), "t")
    places = cut_lineage(dealt.mapInArrow(store, f"key {kind}, file int, start long, length long"))
    files = max(1, -(-places.where("key is not null").count() // FILE_KEYS))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        held: list[pa.RecordBatch] = []
        current = None

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            high, low, prints = (table[c].to_numpy().view(np.uint64) for c in ("high", "low", "print"))
            records = np.zeros(len(high), RECORD)
            records["print"] = prints
            for c in ("file", "start", "length"):
                records[c] = table[c].to_numpy()
            temp = f"{path}/index/.{uuid.uuid4().hex}"
            with fs.open_output_stream(temp) as out:
                out.write(build_index(high, low, records))
            _publish(fs, temp, f"{path}/{index_name(current)}")
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int32()), pa.array([len(high)], pa.int64())], names=["index_file", "keys"])

        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    if held and of[a] != current:
                        yield from done()
                        held = []
                    current = int(of[a])
                    held.append(batch.slice(a, b - a))
        if held:
            yield from done()

    hashed = with_hash(places.where("key is not null"), files)
    by_file = hashed.drop("key").repartition("index_file").sortWithinPartitions("index_file")
    cut_lineage(by_file.mapInArrow(index, "index_file int, keys long"))
    return TokenFiles(folder, width, files, places)


def with_hash(rows: DataFrame, files: int) -> DataFrame:
    """(index_file, high, low, print) of the column ``key`` in front of the other columns."""
    rows = rows.withColumn("key_text", F.col("key").cast("string"))
    schema = T.StructType.fromDDL("index_file int, high long, low long, print long")
    for f in rows.schema.fields[:-1]:
        schema = schema.add(f)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            high, low, prints = key_hash(batch.column(batch.num_columns - 1).to_pylist())
            cols = [
                pa.array(file_of(high, files).astype(np.int32)), pa.array(high.view(np.int64)), pa.array(low.view(np.int64)),
                pa.array(prints.astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays([*cols, *batch.columns[:-1]], names=schema.names)

    return rows.mapInArrow(run, schema)


def look_up(files: TokenFiles, keys: DataFrame) -> DataFrame:
    """(key, file, start, length) of the keys that the index knows."""
    folder, kind = files.folder, dict(keys.dtypes)["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        current, index = None, None
        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b == a:
                    continue
                if of[a] != current:
                    current = int(of[a])
                    name = f"{path}/{index_name(current)}"
                    if fs.get_file_info(name).type == pafs.FileType.NotFound:  # no key of the files falls into it
                        index = IndexFile(build_index(*np.empty((2, 0), np.uint64), np.empty(0, RECORD)))
                    else:
                        with fs.open_input_file(name) as f:
                            index = IndexFile(f.read())
                part = batch.slice(a, b - a)
                high, low, prints = (part.column(k).to_numpy().view(np.uint64) for k in (1, 2, 3))
                found, known = index.look_up(high, low, prints.astype(np.uint32))
                found = found[known]
                cols = [pa.array(found["file"].astype(np.int32)), *(pa.array(found[c].astype(np.int64)) for c in ("start", "length"))]
                yield pa.RecordBatch.from_arrays([part.column(4).filter(pa.array(known)), *cols], names=["key", "file", "start", "length"])

    hashed = with_hash(keys.where("key is not null").select("key"), files.index_files)
    placed = hashed.repartition("index_file").sortWithinPartitions("index_file")
    return placed.mapInArrow(run, f"key {kind}, file int, start long, length long")


def read_back(files: TokenFiles, places: DataFrame, then, schema: str) -> DataFrame:
    """``then`` of the ids (32 bits) of each place: (key, file, start, *results), with ``schema`` of the results."""
    folder, width, kind = files.folder, files.width, dict(places.dtypes)["key"]
    out = T.StructType.fromDDL(f"key {kind}, file int, start long, {schema}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _open(folder)
        current, source = None, None
        for batch in batches:
            rows = []
            for n, start, length in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                if n != current:
                    if source:
                        source.close()
                    current, source = n, fs.open_input_file(f"{path}/{data_name(n)}")
                rows.append(then(np.frombuffer(source.read_at(width * length, width * start), f"<u{width}").astype("<u4")))
            cols = [
                pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(out.fields[3:])
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *cols], names=out.names)
        if source:
            source.close()

    placed = places.select("key", "file", "start", "length").repartitionByRange("file", "start")
    return placed.sortWithinPartitions("file", "start").mapInArrow(run, out)


def base_of(spark: SparkSession, places: DataFrame) -> DataFrame:
    """(file, base): ids in all earlier files; one row for each file passes the driver."""
    sizes = sorted((r.file, r.n) for r in places.groupBy("file").agg(F.sum("length").alias("n")).collect())
    rows, total = [], 0
    for f, n in sizes:
        rows.append((f, total))
        total += n
    return spark.createDataFrame(rows, "file int, base long")
