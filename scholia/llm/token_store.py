"""Token ids in binary shards with a minimal perfect hash index.

Format, in one folder: ``shard-*.ids`` holds the ids of its documents one after another as little-endian unsigned integers (16 bits while
all ids are under 65536, else 32), nothing else; ``shard-*.index`` maps a document key to its place by sections of fixed-width entries: a head of
``HEAD`` bytes (counts, and the sizes of the levels), blocks of 512 bits with the number of set bits before each (the rank of a key's bit is its slot: a minimal perfect
hash), slots (a 32-bit fingerprint that tells foreign keys, the number of records of the key, the first of them), and the records' offsets in ids. Shards and the documents
within them are in ascending order of the key.

Reading one key takes the head (once, while its shard stays open), one block a level tried (two on the mean), one slot, two offsets a record and the ids: ranged reads of
fixed lengths, the same for every size of the shard.

A task writes one shard after another, each of about as much text, under names of its own, and a directory of them (an Arrow file with their first and last keys), which it reports in a row; only rows of tasks that succeeded are read, so lost
executors and repeated attempts leave at most files that nothing refers to. There are ``most_tasks`` tasks at most; so the driver, and what is sent along with the code of a task, holds at most so many rows, however many shards
there are. Which directory holds a key is found by bisection in these rows, which shard by bisection in the directory. The folder is opened by its URI with scheme and store (local, object store, HDFS).

Defined cases: null and empty texts are one end id; a null key comes first and is found as any other; rows that share a key are records of one
slot, ordered by a hash of their text (ties in it, so equal texts, in any order); very long texts are encoded whole, a batch of texts at a time; an empty table
gives an empty store; columns besides the id and the text, whatever their names, play no part.
"""

from __future__ import annotations

import bisect
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, qualified, row_key, stored, text_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


class Encoder:
    """Ids by the tokenizers library for a byte-level BPE without prefix space. A space before other than white space always starts a pre-token,
    so texts are cut there, and each distinct piece of a batch is looked up once and encoded once while it is remembered. A text with a special token's string or a NUL is encoded whole."""

    #: ASCII marks but the apostrophe: after an ASCII letter they always start a pre-token
    MARKS, LETTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
    CUT = re.compile(r"(?= \S)")
    #: a space before white space or at the end
    ODD = r" (?:[\x09-\x0d \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"

    def __init__(self, file: str, remember: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.opens = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)  # ids that begin with a space
        self.opens[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
        self.known: dict[str, bytes] = {}
        self.remember = remember

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _raw_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces. Those that a space opens are encoded in one call as one text: each starts at an id that begins with a space, as no piece has another before
        other than white space."""
        spaced = [p for p in pieces if p[:1] != "\0" and not p[:1].isspace() and " " not in p and p]
        rest = list(set(pieces).difference(spaced))
        out = dict(zip(rest, self._raw([p[1:] if p[:1] == "\0" else " " + p for p in rest]))) if rest else {}
        if spaced:
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(spaced)], add_special_tokens=False)[0].ids, self.dtype)
            cuts, raw, w = [*np.flatnonzero(self.opens[ids]).tolist(), len(ids)], ids.tobytes(), self.dtype.itemsize
            if len(cuts) != len(spaced) + 1:
                raise ValueError("this tokenizer's ids don't show where pieces start; encode whole texts instead")
            out.update((p, raw[a * w : b * w]) for p, a, b in zip(spaced, cuts, cuts[1:]))
        return [out[p] for p in pieces]

    def _pieces(self, text: str) -> list[str]:
        """The text's pieces without the space that opens them; one that no space opens has a NUL before it."""
        return [x[1:] if x[0] == " " and len(x) > 1 else "\0" + x for x in self.CUT.split(text) if x]

    def _looked_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; the first ``remember`` are kept."""
        known = self.known
        found = list(map(known.get, pieces))
        new = [p for p, f in zip(pieces, found) if f is None]
        if not new:
            return found
        ends, need = {}, dict.fromkeys(p for p in new)
        for p in new:
            core = p.rstrip(self.MARKS)
            if len(core) < len(p) and core[-1:] in self.LETTERS:
                ends[p] = core, "\0" + p[len(core) :]
                del need[p]
        need.update((x, None) for pair in ends.values() for x in pair if x not in known)
        made = dict(zip(need, self._raw_pieces(list(need))))
        get = lambda p: known[p] if p in known else made[p]
        made.update([(p, get(a) + get(b)) for p, (a, b) in ends.items()])
        room = self.remember - len(known)
        if room > 0:
            known.update(made if len(made) <= room else islice(made.items(), room))
        return [made[p] if f is None else f for p, f in zip(pieces, found)]

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of each text's."""
        texts = texts.fill_null("")
        whole = pc.match_substring(texts, "\0")
        for s in self.specials:
            whole = pc.or_(whole, pc.match_substring(texts, s))
        odd = pc.or_(whole, pc.match_substring_regex(texts, self.ODD)).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(pc.binary_join_element_wise("\0", texts.filter(pa.array(~odd)), ""), " ")
        sizes, words = np.diff(cut.offsets.to_numpy()), [cut.flatten()]
        plain, extra, extra_sizes = np.flatnonzero(~odd), [], []
        wholes = whole.to_numpy(zero_copy_only=False)
        for t in texts.filter(pa.array(odd & ~wholes)).to_pylist():
            ps = self._pieces(t)
            extra += ps
            extra_sizes.append(len(ps))
        words = pa.chunked_array([*words, pa.array(extra, pa.string())]).combine_chunks().dictionary_encode()
        distinct = words.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), " \0")[0].as_py() if len(distinct) else None
        ids = self._looked_up(joined.split(" \0") if joined is not None else [])
        raw = self._raw(texts.filter(whole).to_pylist())  # texts as pieces of their own
        at = words.indices.to_numpy()
        order = np.concatenate([plain, np.flatnonzero(odd & ~wholes)])
        many = np.concatenate([sizes, np.array(extra_sizes, np.int64)]).astype(np.int64)
        table = ids + raw
        at = np.concatenate([at, np.arange(len(ids), len(table))]).astype(np.int64)
        order, many = np.concatenate([order, np.flatnonzero(wholes)]), np.concatenate([many, np.ones(len(raw), np.int64)])
        # the pieces in the order of the texts
        begins = np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64)
        rank = np.argsort(order, kind="stable")
        at = at[_ranges(begins[rank], many[rank])]
        lengths = np.fromiter(map(len, table), np.int64, len(table)) // self.dtype.itemsize
        flat = np.frombuffer(b"".join(table), self.dtype)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        sums = np.concatenate([[0], np.cumsum(lengths[at])])
        edges = np.concatenate([[0], np.cumsum(many[rank])])
        return flat[_ranges(starts[at], lengths[at])], np.diff(sums[edges])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        flat, counts = self.encode_batch(pa.array(texts, pa.string()))
        ends = np.cumsum(counts)
        return [flat[e - n : e].tobytes() for e, n in zip(ends, counts)]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of each range, one range after another."""
    before = np.concatenate([[0], np.cumsum(lengths)])
    return np.repeat(starts - before[:-1], lengths) + np.arange(before[-1])


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


def key_hash(keys: list) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest("\x00null" if k is None else str(k)) for k in keys], np.uint64)


def _level(h: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (h ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Levels of bits: a key's bit is set on the first level where no other remaining key falls on it; its slot is the number of set bits before."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(bits)])
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray, room: float = 1.5) -> PerfectHash:
        sizes, parts, rest, level = [], [], h, 0
        while len(rest):
            if level == LEVELS:
                raise ValueError("two keys have the same 64-bit hash")
            size = max(1, int(room * len(rest)))
            at = _level(rest, level, size)
            once = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            parts.append(once)
            rest, level = rest[~once[at]], level + 1
        return cls(sizes, np.concatenate(parts) if parts else np.zeros(0, bool))

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 where no level has the key's bit. Keys that aren't in the set may get any slot."""
        out, rest = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = _level(h[rest], level, size) + self.starts[level]
            hit = self.bits[at]
            out[rest[hit]] = self.rank[at[hit]]
            rest = rest[~hit]
        return out


def _fingerprints(h: np.ndarray) -> np.ndarray:
    return ((h * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)


#: The index file: a head of fixed length, then blocks, slots and offsets, each of fixed width.
LEVELS, HEAD = 200, 2048
BLOCK = np.dtype([("rank", "<u8"), ("bits", "u1", 64)])
SLOT = np.dtype([("print", "<u4"), ("many", "<u4"), ("first", "<u8")])


def index_bytes(keys: list, lengths: list[int]) -> bytes:
    """The index of records in order; equal keys stand together."""
    firsts = [i for i, k in enumerate(keys) if i == 0 or k != keys[i - 1]]
    h = key_hash([keys[i] for i in firsts])
    mph = PerfectHash.build(h)
    slot = mph.slots(h)
    n_blocks = -(-len(mph.bits) // 512)
    blocks, slots = np.zeros(n_blocks, BLOCK), np.zeros(len(firsts), SLOT)
    blocks["bits"] = np.packbits(np.pad(mph.bits, (0, n_blocks * 512 - len(mph.bits)))).reshape(n_blocks, 64)
    blocks["rank"] = mph.rank[np.arange(n_blocks) * 512]
    slots["print"][slot], slots["first"][slot], slots["many"][slot] = _fingerprints(h), firsts, np.diff([*firsts, len(keys)])
    head = np.zeros(HEAD // 8, "<u8")
    head[: 4 + len(mph.sizes)] = [len(firsts), len(keys), n_blocks, len(mph.sizes), *mph.sizes]
    return head.tobytes() + blocks.tobytes() + slots.tobytes() + np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes()


class Shard:
    """Keyed access to one shard: ``find`` and ``ids`` by ranged reads, ``records`` for many keys with the whole index in memory. ``bytes_read`` counts."""

    def __init__(self, uri: str, dtype: str):
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.dtype, self.bytes_read = np.dtype(dtype), 0
        head = np.frombuffer(self._read("index", 0, HEAD), "<u8")
        self.n_keys, self.n_records, self.n_blocks, levels = (int(x) for x in head[:4])
        self.sizes = head[4 : 4 + levels].astype(np.int64).tolist()
        self.slots_at = HEAD + self.n_blocks * BLOCK.itemsize
        self.offsets_at = self.slots_at + self.n_keys * SLOT.itemsize
        self._whole: tuple | None = None

    def _read(self, part: str, start: int, length: int) -> bytes:
        with self.fs.open_input_file(f"{self.path}.{part}") as f:
            f.seek(start)
            out = f.read() if length < 0 else f.read(length)
        self.bytes_read += len(out)
        return out

    def find(self, key) -> range:
        """The records of ``key``; none if it isn't here."""
        h, start = key_hash([key]), 0
        for level, size in enumerate(self.sizes):
            at = int(_level(h, level, size)[0]) + start
            block = np.frombuffer(self._read("index", HEAD + at // 512 * BLOCK.itemsize, BLOCK.itemsize), BLOCK)[0]
            bits = np.unpackbits(block["bits"])
            if bits[at % 512]:
                slot = int(block["rank"]) + int(bits[: at % 512].sum())
                s = np.frombuffer(self._read("index", self.slots_at + slot * SLOT.itemsize, SLOT.itemsize), SLOT)[0]
                return range(int(s["first"]), int(s["first"]) + int(s["many"])) if s["print"] == _fingerprints(h)[0] else range(0)
            start += size
        return range(0)

    def ids(self, record: int) -> np.ndarray:
        a, b = np.frombuffer(self._read("index", self.offsets_at + record * 8, 16), "<u8").astype(int).tolist()
        return np.frombuffer(self._read("ids", a * self.dtype.itemsize, (b - a) * self.dtype.itemsize), self.dtype)

    def whole(self) -> tuple[PerfectHash, np.ndarray, np.ndarray]:
        """The index in memory: the hash, its slots and the records' offsets."""
        if self._whole is None:
            raw = self._read("index", HEAD, self.offsets_at + 8 * (self.n_records + 1) - HEAD)
            blocks = np.frombuffer(raw, BLOCK, self.n_blocks)
            mph = PerfectHash(self.sizes, np.unpackbits(blocks["bits"].reshape(-1), count=sum(self.sizes)).astype(bool))
            self._whole = mph, np.frombuffer(raw, SLOT, self.n_keys, self.slots_at - HEAD), np.frombuffer(raw, "<u8", self.n_records + 1, self.offsets_at - HEAD).astype(np.int64)
        return self._whole

    def records(self, keys: list) -> Iterator[tuple[int, int]]:
        """(number of the key, record) of each record of ``keys`` here; keys that aren't here give none."""
        mph, slots, _ = self.whole()
        h = key_hash(keys)
        at = mph.slots(h)
        here = (at >= 0) & (slots["print"][np.maximum(at, 0)] == _fingerprints(h)) if len(slots) else np.zeros(len(h), bool)
        for i in np.flatnonzero(here):
            s = slots[at[i]]
            yield from ((int(i), r) for r in range(int(s["first"]), int(s["first"]) + int(s["many"])))

    def payload(self) -> np.ndarray:
        return np.frombuffer(self._read("ids", 0, -1), self.dtype)


def _gathered(batches: Iterator[pa.RecordBatch], column: int, least_bytes: int = 4_000_000) -> Iterator[pa.Table]:
    """Batches put together until a text column has so many bytes: words repeat more in them."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= least_bytes:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _written(folder: str, tokenizer_file: str, end_id: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, kind, store, root, enc = TaskContext.get().partitionId(), [], None, None, None, None
        keys: list = []
        lengths: list[int] = []
        out, name, size = None, "", 0

        def closed() -> None:
            nonlocal keys, lengths, out, size
            out.close()
            with store.open_output_stream(f"{root}/{name}.index") as f:
                f.write(index_bytes(keys, lengths))
            real = [k for k in keys if k is not None]
            rows.append((f"{folder}/{name}", sum(lengths), real[0] if real else None, real[-1] if real else None, keys[0] is None))
            keys, lengths, out, size = [], [], None, 0

        for t in _gathered((b for b in batches if b.num_rows), 1):
            if enc is None:
                enc, kind = encoder(tokenizer_file), t.column(0).type
                store, root = fs.FileSystem.from_uri(folder)
                store.create_dir(root)
            ends, start = np.cumsum(pc.fill_null(pc.binary_length(t.column(1)), 0).to_numpy().astype(np.int64)), 0
            while start < len(ends):
                before = int(ends[start - 1]) if start else 0
                end = min(int(np.searchsorted(ends, before + shard_bytes - size)) + 1, len(ends))
                piece = t.slice(start, end - start)
                if out is None:
                    name = f"shard-{number:06d}-{len(rows):06d}-{uuid.uuid4().hex[:12]}"
                    out = store.open_output_stream(f"{root}/{name}.ids")
                keys += piece.column(0).to_pylist()
                ids, counts = enc.encode_batch(piece.column(1).combine_chunks())
                out.write(np.insert(ids, np.cumsum(counts), end_id).tobytes())  # each text's ids, then the end id
                lengths += (counts + 1).tolist()
                size, start = size + int(ends[end - 1]) - before, end
                if size >= shard_bytes:
                    closed()
        if out is not None:
            closed()
        if rows:
            uri, n_ids, low, high, null = zip(*rows)
            listed = pa.record_batch([pa.array(uri), pa.array([enc.dtype.str] * len(rows)), pa.array(n_ids), pa.array(low, kind), pa.array(high, kind), pa.array(null)], ["uri", "dtype", "n_ids", "low", "high", "has_null"])
            at = f"directory-{number:06d}-{uuid.uuid4().hex[:12]}"
            with store.open_output_stream(f"{root}/{at}") as f, pa.ipc.new_file(f, listed.schema) as w:
                w.write_batch(listed)
            ends = [k for pair in zip(low, high) for k in pair if k is not None]
            yield pa.record_batch([pa.array([number], pa.int32()), pa.array([f"{folder}/{at}"]), pa.array([len(rows)]), pa.array([sum(n_ids)]), pa.array(ends[:1] or [None], kind), pa.array(ends[-1:] or [None], kind), pa.array([any(null)])], ["number", "uri", "n_shards", "n_ids", "low", "high", "has_null"])

    return run


def _holding(rows: list[dict], key) -> list[int]:
    """The places of the rows, in the order of their keys, between whose low and high key ``key`` lies."""
    if key is None:
        return [i for i, r in enumerate(rows) if r["has_null"]]
    numbers = [i for i, r in enumerate(rows) if r["high"] is not None]
    at, out = bisect.bisect_left(numbers, key, key=lambda i: rows[i]["high"]), []
    while at < len(numbers) and rows[numbers[at]]["low"] <= key:
        out.append(numbers[at])
        at += 1
    return out


def directory(uri: str) -> list[dict]:
    """The shards of a directory in key order, with the number of ids before each in it."""
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        rows = pa.ipc.open_file(f).read_all().to_pylist()
    before = 0
    for r in rows:
        r["before"] = before
        before += r["n_ids"]
    return rows


@dataclass
class TokenStore:
    """Directories in key order: number, uri, low and high key, whether they hold the null key, and the numbers of shards and of ids before. The last ``most_open`` shards and directories used stay open."""

    parts: list[dict]
    most_open: int = 64

    def __post_init__(self):
        self._open: dict = {}

    @property
    def n_shards(self) -> int:
        return sum(p["n_shards"] for p in self.parts)

    def _kept(self, key, make):
        found = self._open.pop(key, None) or make()
        self._open[key] = found
        if len(self._open) > self.most_open:
            del self._open[next(iter(self._open))]
        return found

    def _directory(self, i: int) -> list[dict]:
        return self._kept(i, lambda: directory(self.parts[i]["uri"]))

    def shard(self, i: int, j: int) -> Shard:
        """Shard ``j`` of directory ``i``."""
        r = self._directory(i)[j]
        return self._kept((i, j), lambda: Shard(r["uri"], r["dtype"]))

    def holding(self, key) -> list[tuple[int, int]]:
        """The directories and their shards that may hold ``key``."""
        return [(i, j) for i in _holding(self.parts, key) for j in _holding(self._directory(i), key)]

    def get(self, key) -> list[np.ndarray]:
        """Ids of each record of ``key``, by ranged reads."""
        return [shard.ids(r) for shard in (self.shard(i, j) for i, j in self.holding(key)) for r in shard.find(key)]

    def read(self, keys: DataFrame, most_tasks: int = 8192) -> DataFrame:
        """(key, start, n_tokens, ids_crc32) of every record of the distinct keys in the one column of ``keys``. ``start`` counts the ids of all documents before; the checksum is over little-endian
        unsigned 32-bit ids. Keys go to the tasks of their directories, there to their shards."""
        name, parts = keys.columns[0], self.parts
        kind = keys.schema[name].dataType.simpleString()

        def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [(i, j) for j, k in enumerate(b.column(0).to_pylist()) for i in _holding(parts, k)]
                yield pa.record_batch([pa.array([i for i, _ in found], pa.int32()), b.column(0).take(pa.array([j for _, j in found], pa.int64()))], ["part", "key"])

        def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store = TokenStore(parts, 2)
            for b in batches:
                found = [(i, j, at) for at, (i, k) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())) for j in _holding(store._directory(i), k)]
                part, shard, at = (pa.array([x[c] for x in found], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int64())))
                yield pa.record_batch([part, shard, b.column(1).take(at)], ["part", "shard", "key"])

        def fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, shard, payload, before, store = None, None, None, 0, TokenStore(parts, 2)
            for b in batches:
                part, number = b.column(0).to_numpy(), b.column(1).to_numpy()
                edges = [0, *(np.flatnonzero((np.diff(part) != 0) | (np.diff(number) != 0)) + 1), len(part)]
                for lo, hi in zip(edges, edges[1:]):
                    if lo == hi:
                        continue
                    i, j = int(part[lo]), int(number[lo])
                    if (i, j) != now:
                        r = store._directory(i)[j]
                        now, shard, before = (i, j), Shard(r["uri"], r["dtype"]), parts[i]["before"] + r["before"]
                        payload = shard.payload()
                    got = list(shard.records(b.column(2).slice(lo, hi - lo).to_pylist()))
                    offsets = shard.whole()[2]
                    ids = [payload[offsets[r] : offsets[r + 1]] for _, r in got]
                    yield pa.record_batch(
                        [b.column(2).slice(lo, hi - lo).take(pa.array([i for i, _ in got], pa.int64())), pa.array([before + int(offsets[r]) for _, r in got], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())],
                        [name, "start", "n_tokens", "ids_crc32"],
                    )

        placed = keys.distinct().mapInArrow(located, f"part int, key {kind}")
        tasks = max(1, min(self.n_shards, most_tasks))
        if self.n_shards > len(parts):  # else each directory has one shard, and its keys are where they belong
            placed = placed.repartition(tasks, "part", "key").sortWithinPartitions("part").mapInArrow(sought, f"part int, shard int, key {kind}")
        else:
            placed = placed.select("part", F.lit(0).alias("shard"), "key")
        return placed.repartition(tasks, "part", "shard").sortWithinPartitions("part", "shard").mapInArrow(fetched, f"{name} {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_store(docs: DataFrame, tokenizer_file: str, text_col: str = "text", id_col: str = "doc_id", end_id: int = 0, shard_bytes: int = 24_000_000, folder: str | None = None, most_tasks: int = 4096) -> TokenStore:
    """Encodes and writes ``docs`` in shards of about ``shard_bytes`` of text. The driver holds one small row for each of at most ``most_tasks`` tasks."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(text_bytes(text_col))).first()[0] or 0
    folder = qualified(spark, folder) if folder else new_path(spark, "ids")
    tasks = max(1, min(-(-size // shard_bytes), most_tasks))
    # a task's part may be somewhat larger than the mean; it is one shard all the same while there is a task for each
    roll = shard_bytes if tasks == most_tasks else 1 << 62
    ordered = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("t"), row_key(id_col, text_col).alias("k")).repartitionByRange(tasks, F.col("key").asc_nulls_first(), "k").sortWithinPartitions(F.col("key").asc_nulls_first(), "k")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = stored(ordered.select("key", "t").mapInArrow(_written(folder, tokenizer_file, end_id, roll), f"number int, uri string, n_shards bigint, n_ids bigint, low {kind}, high {kind}, has_null boolean"), "directories")
    parts, before = [], 0
    for r in rows.orderBy("number").collect():
        parts.append(r.asDict() | {"before": before})
        before += r.n_ids
    return TokenStore(parts)
