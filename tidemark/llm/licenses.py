"""Licence scan by ordered signature rules with a keyword prefilter and containment suppression."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import release_memory
from .license_rules import BASE, FRAGMENTS, RULES

_GUARD = "-"
#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a space.
_WORDS = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in bytes(range(256)).lower())
_SPAN = "struct<label:string,rule:int,first_word:long,last_word:long>"


class Rule(NamedTuple):
    rank: int
    label: str
    strength: float
    keywords: tuple[bytes, ...]
    pattern: re.Pattern


class Found(NamedTuple):
    """A match in a text's joined words: byte range and rule."""

    start: int
    stop: int
    rule: Rule


def read_rules(text: str = RULES, fragments: dict[str, str] = FRAGMENTS) -> list[Rule]:
    """Rules in order of priority from lines ``label | strength | keywords | pattern``."""
    out = []
    for line in filter(str.strip, text.splitlines()):
        label, strength, keywords, pattern = line.split(" | ", 3)
        for name, value in fragments.items():
            pattern = pattern.replace("{%s}" % name, value)
        whole = re.compile(b"(?<![^ ])(?:" + pattern.strip().encode() + b")(?![^ ])")
        out.append(Rule(len(out), label.strip(), float(strength), tuple(keywords.strip().encode().split(b",")), whole))
    return out


class Gate:
    """The rules that a text can match at all, by the words it has."""

    def __init__(self, rules: list[Rule]):
        self.by_word: dict[bytes, list[int]] = {}
        self.rules = rules
        for rule in rules:
            for word in rule.keywords:
                self.by_word.setdefault(word, []).append(rule.rank)
        self.words = frozenset(self.by_word)

    def open_for(self, words: list[bytes]) -> list[Rule]:
        ranks = {k for word in self.words.intersection(words) for k in self.by_word[word]}
        return [self.rules[k] for k in sorted(ranks)]


def without_contained(found: list[Found]) -> list[Found]:
    """What no match of an earlier rule contains; of equal ranges the first rule's, in text order.

    Matches come in by rank. Those kept so far matter only as far as none of them lies in
    another, so their starts and their stops both ascend, and the one with the last start at or
    before a new match has the largest stop there is.
    """
    starts: list[int] = []
    stops: list[int] = []
    kept = []
    for x in sorted(found, key=lambda x: (x.rule.rank, x.start, -x.stop)):
        k = bisect_right(starts, x.start)
        if k and stops[k - 1] >= x.stop:
            continue
        kept.append(x)
        a, b = bisect_left(starts, x.start), bisect_right(stops, x.stop)
        starts[a:b], stops[a:b] = [x.start], [x.stop]
    return sorted(kept)


class Scanner:
    def __init__(self, rules: list[Rule] | None = None, base=BASE):
        self.gate = Gate(read_rules() if rules is None else rules)
        self.base = [(phrase.split()[0].encode(), re.compile(b"(?<![^ ])" + phrase.encode() + b"(?![^ ])"), label) for phrase, label in base]

    def detections(self, words: list[bytes], joined: bytes) -> list[Found]:
        """Matches of all rules that the gate lets through, with contained ones taken out."""
        found = [Found(m.start(), m.end(), rule) for rule in self.gate.open_for(words) for m in rule.pattern.finditer(joined) if m.end() > m.start()]
        return without_contained(found)

    def scan(self, text: str | None) -> tuple:
        words = (text or "").encode().translate(_WORDS).split()
        joined = b" ".join(words)
        kept = self.detections(words, joined)
        places, base_labels = [], set()
        for first, phrase, label in self.base:
            starts = [m.start() for m in phrase.finditer(joined)] if first in joined else []
            places += starts
            base_labels |= {label} if starts else set()
        at = _word_numbers(joined, places + [x.start for x in kept] + [max(x.start, x.stop - 1) for x in kept])
        shown = [x for x in kept if x.rule.label != _GUARD]
        doubt = 1.0
        for strength in [0.9] * len(base_labels) + [r.strength for r in sorted({x.rule for x in shown}, key=lambda r: r.rank)]:
            doubt *= 1 - strength
        places = [at[p] for p in places]
        spans = [{"label": x.rule.label, "rule": x.rule.rank, "first_word": at[x.start], "last_word": at[max(x.start, x.stop - 1)]} for x in shown]
        return (
            len(words), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {x.rule.label for x in shown})), min(1.0, 1 - doubt), spans,
        )


def _word_numbers(joined: bytes, offsets: list[int]) -> dict[int, int]:
    """The number of the word at each offset, counted from one offset to the next."""
    out, last, number = {}, 0, 0
    for offset in sorted(set(offsets)):
        number += joined.count(b" ", last, offset)
        out[offset], last = number, offset
    return out


def scan_licenses(docs: DataFrame, text: str = "text", spans: str | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """``docs`` without its text and with what licences the text states.

    Added: ``n_words``; ``n_base``, all places of the base phrases, with ``first_word`` and
    ``last_word``, the smallest and largest number of the word where one starts (null: none);
    ``base_labels`` and ``labels``, the latter with the rules' labels too, both distinct, sorted
    and comma-joined; ``score``, the chance that some detection is right, taking rules as
    independent with their strengths (0 where nothing was found); and ``spans``, if named: the
    detections with label, rule and range of words.

    A text's words gate the rules, each rule's pattern runs over the whole text, and a match
    that lies within an earlier rule's is dropped, guards included; base labels stay whatever
    the rules say. Null and empty texts have no words. Rows stand for themselves, so repeated
    rows and null ids get the same as any other; a column of ``docs`` named like an added one
    gives way to it. One map over the rows, no shuffle.
    """
    added = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    if spans:
        added += f", {spans} array<{_SPAN}>"
    names = [x.split()[0] for x in added.split(", ")]
    left = [c for c in docs.columns if c not in (text, *names)]
    source = docs.select(*[f"`{c}`" for c in left], f"`{text}`")
    schema = ", ".join([f"`{c}` {source.schema[c].dataType.simpleString()}" for c in left] + [added])
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    if spans:
        kinds.append(pa.list_(pa.struct([("label", pa.string()), ("rule", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64())])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            rows = [scanner.scan(t.as_py())[: len(kinds)] for t in batch.column(len(left))]
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(left)], *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[*left, *names])
        release_memory()

    return source.mapInArrow(scan, schema)
