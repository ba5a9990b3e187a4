"""Benchmark decontamination with a generalised suffix automaton over words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of test items in one automaton. More items make more automata, each a further pass
#: over the text within the same stage, so that what a task holds doesn't grow.
ITEM_BYTES = 8 << 20
ADDED = {"n_words": T.LongType(), "hit_spans": T.ArrayType(T.ArrayType(T.IntegerType())), "hit_items": T.ArrayType(T.StringType())}
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters and bytes outside ASCII."""
    return text.translate(_FOLD).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences; a state knows which items contain its words."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, str]] = []
        whole: list[tuple[int, int, str]] = []
        for item, item_words in items:
            last = 0
            for w in item_words:
                last = self._extend(last, self.ids.setdefault(w, len(self.ids)))
                ends.append((last, item))
            if len(item_words) < window:
                whole.append((last, len(item_words), item))
        n = len(self.link)
        self.items: list[set[str]] = [set() for _ in range(n)]
        for state, item in ends:
            self.items[state].add(item)
        order = sorted(range(1, n), key=self.length.__getitem__)
        for s in reversed(order):
            if self.link[s] > 0 and self.length[self.link[s]] >= window:
                self.items[self.link[s]] |= self.items[s]
        own: dict[int, dict[int, set[str]]] = {}
        for state, size, item in whole:
            own.setdefault(state, {}).setdefault(size, set()).add(item)
        #: Short items that end where a state ends: (length, items), through its suffix links.
        self.short: list[tuple] = [()] * n
        for s in order:
            self.short[s] = self.short[self.link[s]] + tuple(own.get(s, {}).items())
        self.shortest = min([window, *(len(w) for _, w in items)])

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, q, c)
        cur = self._state({}, 0, length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, c)
        return cur

    def _state(self, moves: dict[int, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _clone(self, p: int, q: int, c: int) -> int:
        new = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        self.link[q] = new
        return new

    def scan(self, text_words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges ``(first, last)``, ascending and disjoint, and the items found.

        Words that no item has end every match, so only runs of known words are streamed.
        """
        ids = np.fromiter(map(self.ids.get, text_words, repeat(-1)), np.int64, len(text_words))
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids >= 0).view(np.int8), [0]))))
        starts, stops = edge[::2], edge[1::2]
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        for k in np.flatnonzero(stops - starts >= self.shortest):
            self._stream(ids[starts[k] : stops[k]].tolist(), int(starts[k]), spans, found)
        return _joined(spans), found

    def _stream(self, run: list[int], base: int, spans: list, found: set[str]) -> None:
        nxt, link, length, window = self.next, self.link, self.length, self.window
        state = matched = 0
        for at, c in enumerate(run, base):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c not in nxt[state]:
                continue
            state, matched = nxt[state][c], matched + 1
            if matched >= window:
                spans.append((at - matched + 1, at))
                s = state
                while length[link[s]] >= window:
                    s = link[s]
                found |= self.items[s]
            for size, items in self.short[state]:
                if size <= matched:
                    spans.append((at - size + 1, at))
                    found |= items


def _joined(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def _automata(items: DataFrame, item_id: str, text: str, window: int, item_bytes: int) -> list:
    """Broadcast automata, each of about ``item_bytes`` of items."""
    spark = items.sparkSession
    kept = items.where(F.col(text).isNotNull()).select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(text).alias("t"))
    parts = -(-(kept.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // item_bytes)
    out = []
    for k in range(parts):
        rows = kept.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k).collect()  # one bounded part
        named = [(r.i, w) for r in rows if (w := words(r.t.encode()))]
        if named:
            out.append(spark.sparkContext.broadcast(ItemAutomaton(named, window)))
    return out


def scan_documents(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = 10, item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` and ``hit_items``.

    ``hit_spans`` are word ranges inside occurrences of item windows (``window`` consecutive
    words; the whole item where it has fewer), ``hit_items`` the ids (as text) of items with
    such windows. Every row is kept, once per copy; null and empty texts have no words and no
    hits; items without words never match; null item ids count as an empty id. Columns of
    these three names are replaced. Nothing is shuffled.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ADDED])
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t) for n, t in ADDED.items()]])
    out = docs
    for k, automaton in enumerate(_automata(items, item_id, item_text, window, item_bytes) or [None]):
        out = out.mapInArrow(_scanner(automaton, text, k == 0), schema)
    return out


def _scanner(automaton, text: str, first: bool, finish=None):
    """Scans batches with one automaton; ``finish`` may turn a scanned batch into another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton.value if automaton is not None else None
        for batch in batches:
            old = {} if first else {n: batch.column(n).to_pylist() for n in ("hit_spans", "hit_items")}
            counts, spans, items = [], [], []
            for i, t in enumerate(batch.column(text)):
                w = words(t.as_buffer().to_pybytes()) if t.is_valid else []
                hit, found = auto.scan(w) if auto and w else ([], set())
                if not first:
                    hit, found = _joined([*hit, *map(tuple, old["hit_spans"][i])]), found | set(old["hit_items"][i])
                counts.append(len(w))
                spans.append([list(x) for x in hit])
                items.append(sorted(found))
            cols = [(n, batch.column(n)) for n in batch.schema.names if n not in ADDED]
            cols += [
                ("n_words", pa.array(counts, pa.int64())), ("hit_spans", pa.array(spans, pa.list_(pa.list_(pa.int32())))),
                ("hit_items", pa.array(items, pa.list_(pa.string()))),
            ]
            scanned = pa.RecordBatch.from_arrays([c for _, c in cols], names=[n for n, _ in cols])
            yield finish(scanned) if finish else scanned

    return run


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", max_coverage: float = 0.5, window: int = 10, item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """``docs`` without the words that test items share with them.

    Hit spans are cut out of the text, from the first to the last hit word; a document of which
    more than ``max_coverage`` of the words is hit is dropped whole. Documents without a hit,
    null and empty texts included, stay as they are.
    """
    names = [f"_own_{c}" if c in ADDED else c for c in docs.columns]
    own = docs.toDF(*names)
    schema = T.StructType([*own.schema.fields, *[T.StructField(n, t) for n, t in ADDED.items()]])

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        spans, n_words = batch.column("hit_spans").to_pylist(), batch.column("n_words").to_pylist()
        keep = [sum(b - a + 1 for a, b in s) <= max_coverage * n for s, n in zip(spans, n_words)]
        out = [_without(t.as_py(), s) if s and k else t.as_py() for t, s, k in zip(batch.column(text), spans, keep)]
        cols = [pa.array(out, pa.string()) if n == text else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    automata = _automata(items, item_id, item_text, window, item_bytes) or [None]
    for k, automaton in enumerate(automata):
        last = k == len(automata) - 1
        own = own.mapInArrow(_scanner(automaton, text, k == 0, finish if last else None), T.StructType(schema.fields[: len(names)]) if last else schema)
    return own.toDF(*docs.columns)


def _without(text: str, spans: list) -> str:
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw.lower())]
    out, done = [], 0
    for first, last in spans:
        out.append(raw[done : at[first][0]])
        done = at[last][1]
    return b"".join([*out, raw[done:]]).decode()


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and digests of a scan, one row per document."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0] + 1)
    return scanned.select(
        doc_id, "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )

