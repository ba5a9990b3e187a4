"""Exact repeated-substring removal with suffix arrays over shared regions of the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import release_memory, total_bytes

#: Bytes of an anchor; with matches of ``length`` bytes there are ``length - ANCHOR + 1`` of them
#: in each, and the one with the smallest hash stands for the match.
ANCHOR = 20
#: Bytes of text in a block, the unit of work on documents; bytes of strings sorted at once.
BLOCK_BYTES, SORT_BYTES = 8 << 20, 1 << 20
#: Anchors in more blocks than this, with more than ``4 * HOT_BLOCKS**2`` runs that differ in their
#: block, are hot: their matches are dealt one by one. Copies have one run a block and stay cool.
HOT_BLOCKS = 64
#: Bytes hashed at once, of a long text and of small texts together.
_STRIDE, _TOGETHER = 1 << 20, 1 << 16
_TABLE = np.random.default_rng(977).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a run's name that are sent beside its tag.
_NAME = np.uint64(2**48 - 1)


def _anchor_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of every ``ANCHOR`` bytes, the same wherever they stand, by doubling."""
    h, have, out, done = _TABLE[raw], 1, None, 0
    left = ANCHOR
    while left:
        if left & have:
            out = h if out is None else _mix(out[: len(h) - done] * _BASE ^ h[done:]) if done else h
            done += have
            left -= have
        if left:
            h = _mix(h[: len(h) - have] * _BASE ^ h[have:])
            have *= 2
    return out


def _mix(h: np.ndarray) -> np.ndarray:
    return (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Smallest value of every ``width`` values in a row, by doubling."""
    have, out = 1, h
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[: len(h) - width + 1], out[width - have :]) if have < width else out


class Runs:
    """Runs of neighbouring match starts that share an anchor, over some stretch of a text.

    Start s is the match ``raw[s : s + length]``; its anchor is the smallest hash among the
    anchors inside it, which only depends on those bytes, so equal matches have equal anchors. A
    run goes from start ``first`` to start ``last``, ``length - ANCHOR + 1`` starts at most;
    ``anchor`` is the hash and ``key`` names all bytes of its matches. The stretch may be several
    texts, one after the other: ``ends`` tells where each ends, ``text`` which one a run is in.
    """

    def __init__(self, raw: np.ndarray, base: int, length: int, ends: np.ndarray | None = None):
        width = length - ANCHOR + 1
        self.hashes, self.base, self.length = _anchor_hashes(raw), base, length
        low = _sliding_min(self.hashes, width)
        fresh = np.concatenate(([True], low[1:] != low[:-1]))
        if ends is not None:
            cuts = np.concatenate((ends, ends - length + 1))
            fresh[cuts[cuts < len(low)]] = True
        head = np.flatnonzero(fresh)
        size = np.diff(np.append(head, len(low)))
        if ends is not None:  # starts whose match would reach into the next text are none
            inside = head + length <= ends[np.searchsorted(ends, head, "right")]
            head, size = head[inside], size[inside]
        parts = -(-size // width)  # only texts that repeat themselves make longer runs
        stop = np.repeat(head + size, parts)
        head = np.repeat(head, parts) + (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)) * width
        last = np.minimum(head + width, stop) - 1
        self.text = np.zeros(len(head), np.int64) if ends is None else np.searchsorted(ends, head, "right")
        self.anchor, self.first, self.last = low[head], head + base, last + base
        self.key = self._named(head, last + length)

    def _named(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Names of byte ranges of ``length`` to ``4 * ANCHOR`` bytes, from the hashes that cover them."""
        end, out = stop - ANCHOR, (stop - start).astype(np.uint64)
        for at in (start, np.minimum(start + ANCHOR, end), np.minimum(start + 2 * ANCHOR, end), end):
            out = _mix(out * _BASE ^ self.hashes[at])
        return out

    def single(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The starts of some runs, and the names of their single matches."""
        at = _spread(self.first[runs], (self.last - self.first)[runs] + 1) - self.base
        return at + self.base, self._named(at, at + self.length)


def together(texts: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Numbered texts as (numbers, bytes, ends): small ones some at a time, long ones alone and without ends.

    Numpy's cost of a call would else outweigh the work on a small text.
    """
    numbers, held, have = [], [], 0

    def flush():
        return np.array(numbers, np.int64), np.concatenate(held), np.cumsum([len(x) for x in held])

    for k, raw in texts:
        if len(raw) >= _TOGETHER:
            yield np.array([k], np.int64), raw, None
            continue
        numbers.append(k)
        held.append(raw)
        have += len(raw)
        if have >= _TOGETHER:
            yield flush()
            numbers, held, have = [], [], 0
    if held:
        yield flush()


def runs_of(raw: np.ndarray, length: int, ends: np.ndarray | None = None) -> Iterator[Runs]:
    """The runs of a whole text, stretch by stretch, or of the texts with these ends."""
    if 4 * ANCHOR < 2 * length - ANCHOR or length < ANCHOR:
        raise ValueError(f"matches need {ANCHOR} to {5 * ANCHOR // 2} bytes")
    for k in range(0, max(0, len(raw) - length + 1), _STRIDE):
        yield Runs(raw[k : k + _STRIDE + length - 1], k, length, ends)


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``text`` (values 1..255, 0 ends a string) in the order of their suffixes.

    Suffixes compare up to their string's end and need to be told apart up to ``depth`` bytes.
    Two stages: only suffixes smaller than their successors are sorted directly, eight bytes at
    a time; the others are induced: for each byte in ascending order its bucket, once complete,
    is scanned, and the position before each member goes to the end of what its own, larger byte
    has gathered so far. A bucket's induced suffixes come before its sorted ones, as they start
    with the same byte and go on with a smaller one.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    after = np.concatenate((text[1:], np.zeros(1, text.dtype)))
    change = np.flatnonzero(np.concatenate((text[:-1] != text[1:], [True])))
    run_end = change[np.searchsorted(change, np.arange(n))]
    direct = (text[run_end] < after[run_end]) | (text == 0)
    words = _words(text)
    ends = np.flatnonzero(text == 0)
    room = ends[np.searchsorted(ends, np.arange(n))] - np.arange(n)
    typed = np.flatnonzero(direct & (text > 0))
    typed = _refined(typed, words, room, depth)
    by_byte = text[typed]
    cuts = np.searchsorted(by_byte, np.arange(257))
    gathered: list[list[np.ndarray]] = [[] for _ in range(256)]

    def induce(members: np.ndarray) -> None:
        before = members[members > 0] - 1
        before = before[~direct[before]]
        byte = text[before]
        for b in np.unique(byte):
            gathered[b].append(before[byte == b])

    out = [ends]
    induce(ends)
    for b in range(1, 256):
        k = 0
        while k < len(gathered[b]):  # members may add members of their own byte, in order
            induce(gathered[b][k])
            k += 1
        out += gathered[b]
        own = typed[cuts[b] : cuts[b + 1]]
        out.append(own)
        induce(own)
    return np.concatenate(out)


def _words(text: np.ndarray) -> np.ndarray:
    """Eight bytes from every position as one big-endian number, zero after a string's end."""
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, text.dtype)))
    out, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(8):
        byte = padded[k : k + n]
        alive &= byte != 0
        out = (out << np.uint64(8)) | (byte * alive).astype(np.uint64)
    return out


def _refined(at: np.ndarray, words: np.ndarray, room: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in suffix order up to ``depth`` bytes; only what is still tied is sorted again."""
    at = at[np.argsort(words[at], kind="stable")]
    key = words[at]
    group = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]).astype(np.int64)))) if len(at) else at
    for d in range(8, depth, 8):
        same = np.zeros(len(at), bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:]
        tied = np.flatnonzero(same & (room[at] > 0))
        if not len(tied):
            break
        pos = at[tied]
        key = np.where(room[pos] > d, words[np.minimum(pos + d, len(words) - 1)], np.uint64(0))
        order = np.lexsort((key, group[tied]))
        at[tied] = pos[order]
        key = key[order]
        g = group[tied]
        split = np.zeros(len(at), np.int64)
        split[tied[1:]] = (key[1:] != key[:-1]) & (g[1:] == g[:-1])
        group = group + np.cumsum(split)
    return at


def common_prefixes(order: np.ndarray, text: np.ndarray, limit: int) -> np.ndarray:
    """Whether each suffix in order shares its first ``limit`` bytes with the one before it."""
    words = _words(text)
    a, b = order[:-1], order[1:]
    same = np.ones(len(a), bool)
    for d in [*range(0, limit - 7, 8), limit - 8]:
        live = np.flatnonzero(same)
        x, y = words[np.minimum(a[live] + d, len(words) - 1)], words[np.minimum(b[live] + d, len(words) - 1)]
        same[live] = (x == y) & ((x & np.uint64(255)) != 0)
    return np.concatenate(([False], same)) if len(order) else same


def first_owners(strings: list[bytes], owners: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each match start inside ``strings`` the smallest owner of an equal match.

    Strings may share bytes with others; ``owners`` are their smallest documents. Returns, for
    starts with ``length`` bytes left, string number, offset in it and the smallest owner.
    """
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8) + np.uint8(1)  # UTF-8 never has 0xff
    which = np.repeat(np.arange(len(strings)), sizes + 1)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    order = suffix_order(text, length + 6)
    offset = order - starts[which[order]]
    whole = offset + length <= sizes[which[order]]
    shared = common_prefixes(order, text, length)[whole]
    order, offset = order[whole], offset[whole]
    if not len(order):
        none = np.empty(0, np.int64)
        return none, none, none
    shared[0] = False
    heads = np.flatnonzero(~shared)
    least = np.minimum.reduceat(owners[which[order]], heads)
    return which[order], offset, np.repeat(least, np.diff(np.append(heads, len(order))))


def _zipped(x: np.ndarray | bytes) -> bytes:
    raw = x if isinstance(x, bytes) else x.tobytes()
    return pa.compress(raw, "zstd", asbytes=True) if raw else b""


def _unzipped(data: bytes, size: int) -> bytes:
    return pa.decompress(data, size, "zstd", asbytes=True) if size else b""


def _packed(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: bytes that hardly vary cost nothing beside those that do."""
    return _zipped(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)) if len(x) else b""


def _array(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(_unzipped(data, n * size), np.uint8).reshape(size, n).T).view(kind).ravel()


def pack(docs: DataFrame, blocks: int, doc_id: str, text: str) -> DataFrame:
    """Rows ``(block, data)``: documents dealt to blocks by a hash of id and text, compressed.

    ``data`` holds some rows of a block with all their columns, so that texts are shuffled once,
    at half their size, and carried whole.
    """
    dealt = docs.withColumn("_block", F.pmod(F.xxhash64(F.col(doc_id), F.col(text)), F.lit(blocks)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for held in _gathered(batches, 32 << 20):
            block = held.column("_block").to_numpy()
            order = np.argsort(block, kind="stable")
            held, cuts = held.drop_columns(["_block"]), np.flatnonzero(np.diff(block[order], prepend=-1, append=-1))
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                sink = pa.BufferOutputStream()
                part = held.take(pa.array(order[lo:hi])).combine_chunks()
                with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                    out.write_table(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block[order[lo]]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_block", "_data"],
                )

    return dealt.mapInArrow(run, "_block int, _data binary")


def _gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held, have = [], 0
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            part = batch.slice(k, 512)
            held.append(part)
            have += part.nbytes
            if have >= size:
                yield pa.Table.from_batches(held)
                held, have = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _tables(data) -> Iterator[pa.Table]:
    for x in data:
        with pa.ipc.open_stream(x.as_buffer()) as stream:
            yield stream.read_all()


def _documents(table: pa.Table, doc_id: str, text: str) -> Iterator[tuple[int | None, np.ndarray]]:
    for k, t in zip(table.column(doc_id), table.column(text)):
        yield k.as_py(), np.frombuffer(t.as_buffer() if t.is_valid else b"", np.uint8)


class _Stages:
    """The steps over blocks and anchor buckets, as functions for grouped Arrow data."""

    def __init__(self, doc_id: str, text: str, length: int, buckets: int, hot_blocks: int, tag_bits: int):
        self.doc_id, self.text, self.length, self.buckets, self.hot_blocks, self.tag_bits = doc_id, text, length, buckets, hot_blocks, tag_bits

    def documents(self, data) -> Iterator[tuple[int, np.ndarray]]:
        """Documents of a block that can match."""
        for table in _tables(data):
            for k, raw in _documents(table, self.doc_id, self.text):
                if k is not None and len(raw) >= self.length:
                    yield k, raw

    def tag(self, h: np.ndarray) -> np.ndarray:
        """Short hashes of anchors or names, from 1 on: what shares a tag is only compared, not taken to be equal."""
        return (_mix(h) >> np.uint64(64 - self.tag_bits)) + np.uint64(1)

    @staticmethod
    def key(tag: np.ndarray, name: np.ndarray) -> np.ndarray:
        """What stands for a run: its tag and the part of its name that is sent along."""
        return _mix(tag * _BASE ^ (name & _NAME))

    def bucket(self, tag: np.ndarray) -> np.ndarray:
        return (tag % np.uint64(self.buckets)).astype(np.int64)

    def packed_tags(self, tag: np.ndarray) -> bytes:
        """Ascending tags of one bucket."""
        return _packed(np.diff(tag // np.uint64(self.buckets), prepend=np.uint64(0)))

    def tags(self, bucket: int, data: bytes, n: int) -> np.ndarray:
        return np.cumsum(_array(data, n, np.uint64), dtype=np.uint64) * np.uint64(self.buckets) + np.uint64(bucket)

    def mark(self):
        """A block's distinct anchors to their buckets, whether several documents have them, and how many runs they have."""

        def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found, names, texts, seen = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
            for batch in batches:
                for docs, raw, ends in together(self.documents(batch.column("_data"))):
                    for r in runs_of(raw, self.length, ends):
                        found.append(self.tag(r.anchor))
                        names.append(r.key)
                        texts.append(r.text + seen)
                    seen += len(docs)
            h, text, name = np.concatenate(found), np.concatenate(texts), np.concatenate(names)
            order = np.lexsort((name, h))
            runs = np.unique(h[order][_changes(h[order], name[order])], return_counts=True)[1].astype(np.int32)
            order = np.argsort(h, kind="stable")  # texts stay in order
            h, n = np.unique(h[order][_changes(h[order], text[order])], return_counts=True)
            rows = [
                (b, key[0].as_py(), len(some), self.packed_tags(h[some]), _zipped(n[some] > 1), _packed(runs[some]))
                for b, some in _split(self.bucket(h))
            ]
            yield from _emitted(_MARKED, rows)
            release_memory()

        return run

    def share(self):
        """To each block its anchors that other documents have too, and which of them are hot."""

        def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks, parts, many, runs = [], [], [], []
            for batch in batches:
                for b, n, a, m, r in zip(*[batch.column(c).to_pylist() for c in ("block", "n", "anchors", "many", "runs")]):
                    runs.append(_array(r, n, np.int32))
                    blocks.append(b)
                    parts.append(self.tags(key[0].as_py(), a, n))
                    many.append(_array(m, n, bool))
            h = np.concatenate(parts)
            order = np.argsort(h, kind="stable")
            start = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
            count = np.diff(np.append(start, len(h)))
            several = np.add.reduceat(np.concatenate(many)[order], start, dtype=np.int64)
            shared, hot = np.empty(len(h), bool), np.empty(len(h), bool)
            shared[order] = np.repeat((count > 1) | (several > 0), count)
            differing = np.add.reduceat(np.concatenate(runs)[order], start, dtype=np.int64)
            hot[order] = np.repeat((count > self.hot_blocks) & (differing > 4 * self.hot_blocks**2), count)
            rows, at = [], 0
            for b, part in zip(blocks, parts):
                keep = np.flatnonzero(shared[at : at + len(part)])
                if len(keep):
                    rows.append((b, key[0].as_py(), len(keep), self.packed_tags(part[keep]), _zipped(hot[at : at + len(part)][keep])))
                at += len(part)
            yield from _emitted(_SHARED, rows)
            release_memory()

        return run

    def name(self):
        """A block's distinct runs around shared anchors, by name, with their least and largest document.

        Hot anchors' matches are named one by one and dealt by their own names.
        """

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            parts = [(self.tags(b, a, n), _array(x, n, bool)) for b, n, a, x in _columns(right, "bucket", "n", "anchors", "hot")]
            known = np.concatenate([np.empty(0, np.uint64), *[p[0] for p in parts]])
            order = np.argsort(known)
            known, hot = known[order], np.concatenate([np.empty(0, bool), *[p[1] for p in parts]])[order]
            tags, keys, docs, own = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for ids, raw, ends in together(self.documents(left.column("_data"))) if len(known) else ():
                for r in runs_of(raw, self.length, ends):
                    found, doc = self.tag(r.anchor), ids[r.text]
                    at = _found(known, found)
                    hit = at >= 0
                    single = hit & hot[at]
                    hit &= ~single
                    got = [(found[hit], r.key[hit], np.zeros(hit.sum(), np.uint64), doc[hit])]
                    if single.any():
                        names = r.single(single)[1]
                        many = r.last[single] - r.first[single] + 1
                        got.append((self.tag(names), names, np.repeat(found[single], many), np.repeat(doc[single], many)))
                    for tag, name, anchor, k in got:
                        tags.append(tag)
                        keys.append(name & _NAME)
                        docs.append(k)
                        own.append(anchor)
            tag, name, doc, own = np.concatenate(tags), np.concatenate(keys), np.concatenate(docs), np.concatenate(own)
            order = np.lexsort((doc, name, tag))
            tag, name, doc, own = tag[order], name[order], doc[order], own[order]
            head = np.flatnonzero(_changes(tag, name))
            last = np.append(head[1:], len(tag)) - 1
            tag, name, lo, hi = tag[head], name[head], doc[head], doc[last] if len(head) else doc[head]
            rows = [
                (b, key[0].as_py(), len(some), self.packed_tags(tag[some]), *[_packed(x[some]) for x in (name, lo, hi - lo, own[head])])
                for b, some in _split(self.bucket(tag))
            ]
            return _table(_NAMED, rows)

        return run

    def named(self, bucket: int, rows) -> tuple[np.ndarray, ...]:
        """Tag, key, least and largest document, own anchor and row of all named runs of a bucket."""
        parts = [
            (tag := self.tags(bucket, t, n), self.key(tag, _array(k, n, np.uint64)), lo := _array(x, n, np.int64), lo + _array(y, n, np.int64), _array(a, n, np.uint64), np.full(n, i))
            for i, (n, t, k, x, y, a) in enumerate(rows)
        ]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def ask(self):
        """Where runs of an anchor differ, one block with each is asked for its bytes, which a named document has."""

        def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows, blocks = [], []
            for batch in batches:
                rows += _columns(batch, "n", "tags", "keys", "lo", "his", "anchors")
                blocks += batch.column("block").to_pylist()
            tag, name, lo, _, _, row = self.named(key[0].as_py(), rows)
            order = np.lexsort((lo, name, tag))
            tag, name, lo, row = tag[order], name[order], lo[order], row[order]
            distinct = np.flatnonzero(_changes(tag, name))
            tag, name, lo, row = tag[distinct], name[distinct], lo[distinct], row[distinct]
            differ = np.concatenate((tag[1:] == tag[:-1], [False]))
            differ[1:] |= differ[:-1].copy()
            name, lo, block = name[differ], lo[differ], np.array(blocks, np.int64)[row[differ]]
            yield from _emitted(_ASKED, [(b, len(some), _packed(name[some]), _packed(lo[some])) for b, some in _split(block)])

        return run

    def spell(self):
        """The bytes of the runs that a block was asked for."""

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            asked = [(_array(k, n, np.uint64), _array(d, n, np.int64)) for n, k, d in _columns(right, "n", "keys", "docs")]
            known = np.unique(np.concatenate([np.empty(0, np.uint64), *[a[0] for a in asked]]))
            holders = set(np.concatenate([np.empty(0, np.int64), *[a[1] for a in asked]]).tolist())
            tags, names, strings = [], [], []
            done = np.zeros(len(known), bool)
            for _, raw, ends in together(d for d in self.documents(left.column("_data")) if d[0] in holders):
                for r in runs_of(raw, self.length, ends):
                    tag = self.tag(r.anchor)
                    key_of = self.key(tag, r.key)
                    at = _found(known, key_of)
                    hits = np.flatnonzero((at >= 0) & ~done[at])
                    for i in hits.tolist():
                        if not done[at[i]]:
                            done[at[i]] = True
                            tags.append(tag[i])
                            names.append(key_of[i])
                            strings.append(raw[r.first[i] : r.last[i] + self.length].tobytes())
            name, rows = np.array(names, np.uint64), []
            for b, some in _split(self.bucket(np.array(tags, np.uint64))):
                own = [strings[i] for i in some]
                rows.append((b, len(own), _packed(name[some]), _packed(np.array([len(x) for x in own], np.int64)), sum(map(len, own)), _zipped(b"".join(own))))
            return _table(_SPELT, rows)

        return run

    def decide(self):
        """For each named run, the starts whose match an earlier document has; to the blocks with it.

        A run that is all its anchor has belongs to its least document. The others' bytes are
        suffix-sorted, and each start belongs to the least document with an equal match.
        """

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return _table(_DECIDED, [])
            blocks = left.column("block").to_pylist()
            tag, name, lo, hi, anchor, row = self.named(left.column("bucket")[0].as_py(), _columns(left, "n", "tags", "keys", "lo", "his", "anchors"))
            order = np.lexsort((lo, name, tag))
            tag, name, lo, hi, anchor, row = tag[order], name[order], lo[order], hi[order], anchor[order], row[order]
            new = _changes(tag, name)
            which = np.cumsum(new) - 1
            head = np.flatnonzero(new)
            least, tags, names = lo[head], tag[head], name[head]
            spelt = [(_array(k, n, np.uint64), _array(z, n, np.int64), _unzipped(x, m)) for n, k, z, m, x in _columns(right, "n", "keys", "sizes", "n_bytes", "strings")]
            own = np.concatenate([np.empty(0, np.uint64), *[p[0] for p in spelt]])
            strings = [x[e - z : e] for _, sizes, x in spelt for e, z in zip(np.cumsum(sizes).tolist(), sizes.tolist())]
            by = np.argsort(own)
            at = _found(own[by], names)
            sorted_ones = np.flatnonzero(at >= 0)
            runs = self._owned_runs([strings[by[i]] for i in at[sorted_ones]], least[sorted_ones], tags[sorted_ones])
            runs[0] = sorted_ones[runs[0]]
            whole = np.setdiff1d(np.arange(len(head)), sorted_ones, assume_unique=True)
            runs = [np.concatenate((x, y)) for x, y in zip(runs, (whole, np.zeros(len(whole), np.int64), np.full(len(whole), -1), least[whole]))]
            sort = np.lexsort((runs[1], runs[0]))
            runs = [x[sort] for x in runs]
            first = np.searchsorted(runs[0], np.arange(len(head) + 1))
            many = first[which + 1] - first[which]
            pick = _spread(first[which], many)
            entry = np.repeat(np.arange(len(which)), many)
            drop = runs[3][pick] < hi[entry]
            entry, pick = entry[drop], pick[drop]
            rows = []
            for b, some in _split(np.array(blocks, np.int64)[row[entry]]):
                k = np.argsort(name[entry[some]], kind="stable")
                e, p = entry[some][k], pick[some][k]
                rows.append((b, len(e), _packed(np.diff(name[e], prepend=np.uint64(0))), *[_packed(runs[c][p].astype(t)) for c, t in ((1, np.int32), (2, np.int32), (3, np.int64))], _packed(anchor[e])))
            return _table(_DECIDED, rows)

        return run

    def _owned_runs(self, strings: list[bytes], least: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
        """String number, offset, length and least owner of each stretch of starts with one owner.

        Equal matches have equal tags, so strings are sorted some tags at a time; tags ascend.
        """
        sizes = np.cumsum([len(x) + 1 for x in strings])
        ends = np.flatnonzero(np.concatenate((tags[1:] != tags[:-1], [True]))) + 1 if len(tags) else tags
        out, lo = [], 0
        while lo < len(strings):
            base = sizes[lo - 1] if lo else 0
            k = np.searchsorted(ends, max(lo + 1, np.searchsorted(sizes, base + SORT_BYTES)))
            hi = int(ends[min(k, len(ends) - 1)])
            which, offset, owner = first_owners(strings[lo:hi], least[lo:hi], self.length)
            sort = np.lexsort((offset, which))
            which, offset, owner = which[sort] + lo, offset[sort], owner[sort]
            head = np.flatnonzero(_changes(which, owner))
            out.append((which[head], offset[head], np.diff(np.append(head, len(which))), owner[head]))
            lo = hi
        if not out:
            return [np.empty(0, np.int64) for _ in range(4)]
        return [np.concatenate(x) for x in zip(*out)]

    def remove(self, digest: bool, schema: pa.Schema):
        """A block's documents without the bytes that earlier documents have."""

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            parts = [
                (np.cumsum(_array(k, n, np.uint64), dtype=np.uint64), _array(o, n, np.int32), _array(z, n, np.int32), _array(w, n, np.int64), _array(a, n, np.uint64))
                for n, k, o, z, w, a in _columns(right, "n", "keys", "offsets", "lengths", "owners", "anchors")
            ]
            reply = [np.concatenate(x) for x in zip(*parts)] if parts else []
            if reply:
                order = np.argsort(reply[0], kind="stable")
                reply = [*[x[order] for x in reply[:4]], np.unique(reply[4][reply[4] > 0])]
            out = []
            for table in _tables(left.column("_data")):
                docs = list(_documents(table, self.doc_id, self.text))
                kept, n_bytes, n_removed, n_spans = [x.tobytes() for _, x in docs], [len(x) for _, x in docs], [0] * len(docs), [0] * len(docs)
                able = ((i, x) for i, (k, x) in enumerate(docs) if k is not None and len(x) >= self.length) if reply else ()
                for rows, raw, ends in together(able):
                    gone = self._gone(np.array([docs[i][0] for i in rows], np.int64), raw, ends, reply)
                    stops = np.array([len(raw)]) if ends is None else ends
                    for i, lo, hi in zip(rows.tolist(), np.append(0, stops[:-1]).tolist(), stops.tolist()):
                        own = gone[lo:hi]
                        if own.any():
                            kept[i], n_removed[i] = raw[lo:hi][~own].tobytes(), int(own.sum())
                            n_spans[i] = int(own[0]) + int((own[1:] & ~own[:-1]).sum())
                if digest:
                    cols = [table.column(self.doc_id), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
                    names = [self.doc_id, "kept_sha256"]
                else:
                    texts = [
                        t if not gone else x.decode("utf-8", "ignore") for t, gone, x in zip(table.column(self.text).to_pylist(), n_removed, kept)
                    ]
                    cols, names = [pa.array(texts, pa.string()) if n == self.text else table.column(n) for n in table.column_names], table.column_names
                cols += [pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)]
                out.append(pa.table(cols, names=[*names, "n_bytes", "n_removed", "n_spans"]).select(schema.names).cast(schema))
            return pa.concat_tables(out) if out else schema.empty_table()

        return run

    def _gone(self, ids: np.ndarray, raw: np.ndarray, ends: np.ndarray | None, reply: list[np.ndarray]) -> np.ndarray:
        """Which bytes are covered by matches that a smaller document has."""
        keys, offset, size, owner, hot = reply
        edge = np.zeros(len(raw) + 1, np.int64)
        for r in runs_of(raw, self.length, ends):
            tag = self.tag(r.anchor)
            names = [(r.first, r.last - r.first + 1, self.key(tag, r.key), ids[r.text])]
            single = _found(hot, tag) >= 0
            if single.any():
                at, name = r.single(single)
                names.append((at, np.ones(len(at), np.int64), self.key(self.tag(name), name), np.repeat(ids[r.text[single]], (r.last - r.first)[single] + 1)))
            for first, n, name, doc in names:
                lo = np.searchsorted(keys, name)
                hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == name)
                many = np.searchsorted(keys, name[hit], "right") - lo[hit]
                pick, run = _spread(lo[hit], many), np.repeat(hit, many)
                ours = owner[pick] < doc[run]
                pick, run = pick[ours], run[ours]
                begin = first[run] + offset[pick]
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + np.where(size[pick] < 0, n[run], size[pick]) - 1 + self.length, -1)
        return np.cumsum(edge[:-1]) > 0


_MARKED = {"bucket": pa.int32(), "block": pa.int32(), "n": pa.int64(), "anchors": pa.binary(), "many": pa.binary(), "runs": pa.binary()}
_SHARED = {"_block": pa.int32(), "bucket": pa.int32(), "n": pa.int64(), "anchors": pa.binary(), "hot": pa.binary()}
_NAMED = {"bucket": pa.int32(), "block": pa.int32(), "n": pa.int64(), "tags": pa.binary(), "keys": pa.binary(), "lo": pa.binary(), "his": pa.binary(), "anchors": pa.binary()}
_ASKED = {"_block": pa.int32(), "n": pa.int64(), "keys": pa.binary(), "docs": pa.binary()}
_SPELT = {"bucket": pa.int32(), "n": pa.int64(), "keys": pa.binary(), "sizes": pa.binary(), "n_bytes": pa.int64(), "strings": pa.binary()}
_DECIDED = {"_block": pa.int32(), "n": pa.int64(), "keys": pa.binary(), "offsets": pa.binary(), "lengths": pa.binary(), "owners": pa.binary(), "anchors": pa.binary()}


def _split(group: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each group number with its positions, which stay in order."""
    order = np.argsort(group, kind="stable")
    cuts = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1)) if len(group) else []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        yield int(group[order[lo]]), order[lo:hi]


def _changes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where a sorted pair of columns differs from the row before."""
    return np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)


def _found(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Positions of values in a sorted array, -1 where they aren't in it."""
    if not len(known):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, -1)


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``first``, ``first + 1`` and so on, ``many`` of each, one after the other."""
    return np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)


def _columns(rows, *names: str) -> list[tuple]:
    return list(zip(*[rows.column(c).to_pylist() for c in names]))


def _table(columns: dict, rows: list[tuple]) -> pa.Table:
    release_memory()
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(columns.items())})


def _emitted(columns: dict, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    yield from _table(columns, rows).to_batches()


def _ddl(columns: dict) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    return ", ".join(f"{n} {kinds[t]}" for n, t in columns.items())


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 50, digest: bool = False, block_bytes: int = BLOCK_BYTES, hot_blocks: int = HOT_BLOCKS,
    tag_bits: int | None = None,
) -> DataFrame:
    """``docs`` without the bytes covered by a ``length``-byte string that also starts in a smaller document.

    Texts are UTF-8 bytes; strings are judged on the input and don't cross documents. Added (and
    replaced, where they exist): ``n_bytes``, ``n_removed``, ``n_spans`` (maximal runs). With
    ``digest`` the rows are the id, these and ``kept_sha256`` of the remaining bytes; else the
    columns of ``docs``, the text without the removed bytes and without what is left of letters
    cut in two. Ids must be integers. Null and empty texts and null ids have nothing removed, and
    a null id counts as no document; rows with equal ids don't remove from each other. Empty
    tables give empty tables.

    Method: every match has an anchor, the smallest hash of ``ANCHOR`` bytes in it. Blocks of
    documents send their distinct anchors to buckets, which answer with those that several
    documents have. Around these, blocks name their runs of matches, each distinct run once with
    its smallest document, however many documents hold it. Where runs of an anchor differ, one
    block with each sends its bytes; buckets sort their suffixes and tell the blocks which starts
    an earlier document has. Anchors that very many blocks have with varied runs are dealt match by match, so that
    one passage's varied surroundings don't meet in one task. Texts are shuffled once,
    compressed. Anchors travel as tags of ``tag_bits``, enough for few to share one by chance, which costs
    a look but changes nothing; a run is its tag and 48 bits of hash, replies to a block name it by 64.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] if digest else ["n_bytes", "n_removed", "n_spans"]
    docs = docs.select(doc_id, text) if digest else docs.select(*[c for c in docs.columns if c not in added])
    size = total_bytes(docs, text)
    blocks = max(1, -(-size // block_bytes))
    packed = pack(docs, blocks, doc_id, text)
    # a byte in 16 has an anchor of its own; 8 bits more, so that few have another's tag
    stages = _Stages(doc_id, text, length, blocks, hot_blocks, tag_bits or min(60, int(size).bit_length() + 4))
    marked = packed.groupBy("_block").applyInArrow(stages.mark(), _ddl(_MARKED))
    shared = marked.groupBy("bucket").applyInArrow(stages.share(), _ddl(_SHARED))
    named = packed.groupBy("_block").cogroup(shared.groupBy("_block")).applyInArrow(stages.name(), _ddl(_NAMED))
    asked = named.groupBy("bucket").applyInArrow(stages.ask(), _ddl(_ASKED))
    spelt = packed.groupBy("_block").cogroup(asked.groupBy("_block")).applyInArrow(stages.spell(), _ddl(_SPELT))
    decided = named.groupBy("bucket").cogroup(spelt.groupBy("bucket")).applyInArrow(stages.decide(), _ddl(_DECIDED))
    if digest:
        fields = [docs.schema[doc_id], *[T.StructField(n, T.LongType()) for n in added[:3]], T.StructField("kept_sha256", T.StringType())]
    else:
        fields = [*docs.schema.fields, *[T.StructField(n, T.LongType()) for n in added]]
    schema = T.StructType(fields)
    return packed.groupBy("_block").cogroup(decided.groupBy("_block")).applyInArrow(stages.remove(digest, to_arrow_schema(schema)), schema)
