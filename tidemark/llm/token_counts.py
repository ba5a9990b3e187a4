"""Token counts under a unigram model, scored once per shared prefix of the pre-tokens."""

from __future__ import annotations

import math
import struct
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import release_memory

#: Distinct pre-tokens whose counts a worker remembers, and the longest that it remembers.
MEMO_SIZE, MEMO_CHARS = 200_000, 64
#: What a character outside the vocabulary scores below the worst piece.
UNKNOWN_PENALTY = 10.0
_MODELS: dict[str, "Pieces"] = {}


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int | float]]:
    """Fields of a protocol buffer message: number and raw value."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = out = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = 8 if kind == 1 else 4 if kind == 5 else varint()
            yield key >> 3, data[at : at + size]
            at += size


class Pieces:
    """Pieces and scores of a vocabulary file, and the trie walk that counts tokens with them."""

    def __init__(self, scores: dict[str, float], marker: str = "▁"):
        if not scores:
            raise ValueError("a vocabulary needs pieces")
        self.scores, self.marker = scores, marker
        self.longest = max(map(len, scores))
        self.unknown = min(scores.values()) - UNKNOWN_PENALTY
        self.memo: dict[str, int] = {}

    @classmethod
    def from_model(cls, path: str) -> Pieces:
        """Normal pieces of a piece model file (field 1: piece 1, score 2, type 3)."""
        scores: dict[str, float] = {}
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    if piece.get(3, 1) == 1:
                        scores[piece[1].decode()] = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
        return cls(scores)

    def count_sorted(self, pretokens: list[str]) -> dict[str, int]:
        """Token counts of distinct pre-tokens, given in ascending order.

        That order walks their trie depth first: the path is kept as a stack with one node per
        character, each holding the best forward score of its prefix and the number of tokens of
        the best segmentation. Going on to the next pre-token drops the nodes beyond the common
        prefix, so every node of the trie is scored once, and its terminal count is stored
        when the walk stands at the pre-token's end. A prefix's best score is the largest
        of an earlier prefix's score and the piece between; the longest piece wins ties, and a
        character that no piece covers counts as its UTF-8 bytes.
        """
        get, longest, unknown = self.scores.get, self.longest, self.unknown
        best, tokens = [0.0], [0]
        path = ""
        out: dict[str, int] = {}
        for p in pretokens:
            word = self.marker + p
            top = min(len(path), len(word))
            same = 0
            while same < top and path[same] == word[same]:
                same += 1
            del best[same + 1 :], tokens[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                high, n = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    s = get(word[start:end])
                    if s is not None and best[start] + s > high:
                        high, n = best[start] + s, tokens[start] + 1
                last = word[end - 1]
                if get(last) is None and best[end - 1] + unknown > high:
                    high, n = best[end - 1] + unknown, tokens[end - 1] + len(last.encode("utf-8", "surrogatepass"))
                best.append(high)
                tokens.append(n)
            path = word
            out[p] = tokens[-1]
        return out

    def counts(self, pretokens: set[str]) -> dict[str, int]:
        """Counts of distinct pre-tokens, through the memo; the new ones share a trie."""
        memo = self.memo
        new = sorted(p for p in pretokens if p not in memo)
        fresh = self.count_sorted(new)
        out = {p: memo[p] if p in memo else fresh[p] for p in pretokens}
        if len(memo) + len(fresh) > MEMO_SIZE:
            memo.clear()
        memo.update((p, n) for p, n in list(fresh.items())[:MEMO_SIZE] if len(p) <= MEMO_CHARS)
        return out


def _pieces(path: str) -> Pieces:
    if path not in _MODELS:
        _MODELS[path] = Pieces.from_model(path)
    return _MODELS[path]


def count_tokens(docs: DataFrame, path: str, text: str = "text", chars_at_once: int = 2_000_000) -> DataFrame:
    """``docs`` with ``n_pretokens`` and ``n_tokens``, replacing columns of those names.

    Pre-tokens are what white space separates, each with the word mark before it; a document's
    tokens are those of its pre-tokens' best segmentations under the file's pieces and scores.
    Distinct pre-tokens of some ``chars_at_once`` characters of documents share one trie. Null
    and empty texts count 0. Whole texts are counted, a row's count doesn't depend on other
    rows, and nothing is shuffled.
    """
    docs = docs.select(*[c for c in docs.columns if c not in ("n_pretokens", "n_tokens")])
    schema = T.StructType([*docs.schema.fields, T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())])
    where = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(path)
        for batch in batches:
            column = batch.column(where)
            n_pre, n_tok, bags, size = [], [], [], 0

            def settle() -> None:
                nonlocal size
                known = pieces.counts(set().union(*bags))
                n_pre.extend(b.total() for b in bags)
                n_tok.extend(sum(known[p] * c for p, c in b.items()) for b in bags)
                bags.clear()
                size = 0

            for t in column:
                s = t.as_py() or ""
                bags.append(Counter(s.split()))
                size += len(s)
                if size >= chars_at_once:
                    settle()
            settle()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_pre, pa.int64()), pa.array(n_tok, pa.int64())], names=[*batch.schema.names, "n_pretokens", "n_tokens"],
            )
        pieces.memo.clear()
        release_memory()

    return docs.mapInArrow(run, schema)
