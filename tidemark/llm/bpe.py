"""BPE encoding and decoding as a streaming transducer with bounded lookahead."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release_memory

#: Entries of either half of a worker's memo of encoded chunks, the longest chunk it keeps, and
#: tokens passed on together.
MEMO_SIZE, MEMO_CHARS, PORTION = 120_000, 64, 4096
#: Letters and numbers of the ``regex`` module's Unicode version that the
#: splitter's version doesn't have yet, and lower case that Python's version doesn't know yet.
_NEWER = (
    "\\u0558\\u058b\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce\\ua7cf\\ua7dd\\ua7e2\\ua7f1\\uab6c\\uab6d"
    "\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a"
    "\\U00011db0-\\U00011ddb\\U00011de0-\\U00011de9\\U00011df1\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686"
    "\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff6\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda"
    "\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128"
    "\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff"
    "\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4\\U0001e6e5\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4"
    "\\U0001e6fe\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
)
_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 32 for c in range(0x10D50, 0x10D66)}, **{c: c + 27 for c in range(0x16EA0, 0x16EB9)},
}
_FRESH = regex.compile(f"[{_NEWER}]")
_LATE = regex.compile("[\u03a3" + "".join(map(chr, _LOWER)) + "]")
#: White space as the normaliser's pattern has it, which isn't what ``str.split()`` takes.
_SPACE = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_ODD_SPACE = regex.compile("[\\x1c-\\x1f]")
_ENCODERS: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _pattern(source: str) -> regex.Pattern:
    """The splitter's pattern with the letters and numbers of its own Unicode version."""
    for kind in (r"\p{L}", r"\p{N}"):
        source = source.replace(kind, f"[{kind}--[{_NEWER}]]")
    return regex.compile(source, regex.V1)


def _normal(text: str) -> str:
    """Composed and lower-cased letter by letter (a sigma's place in its word doesn't count)."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.lower() if not _LATE.search(text) else "".join([c.lower() for c in text.translate(_LOWER)])


class MergeList:
    """Merges by rank over token ids, and how far to the right a token's fate can be decided."""

    def __init__(self, merges: list[tuple[str, str]], vocab: dict[str, int], end: str):
        self.end = end
        #: The rank of a pair of ids, by its left id, and the id that each rank makes.
        self.rank: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        self.makes = [vocab[u + v] for u, v in merges]
        for k, (u, v) in enumerate(merges):
            self.rank[vocab[u]][vocab[v]] = k
        self.size = {i: len(t) - len(end) if end and t.endswith(end) and t != end else len(t) for t, i in vocab.items()}
        self.letter = {c: vocab[c] for c in _byte_letters().values()}
        self.last = {c: vocab[c + end] for c in self.letter}
        self.byte = [self.letter[c] for _, c in sorted(_byte_letters().items())]
        self.last_byte = [self.last[c] for _, c in sorted(_byte_letters().items())]
        self.lookahead = self._sufficient_lookahead(merges)

    def _sufficient_lookahead(self, merges: list[tuple[str, str]]) -> int:
        """Letters after a token's end that settle it, whatever follows them.

        Run the merges, in rank order, on a text and on a longer text with the same beginning.
        Call the edge the leftmost place from which on their symbols differ; it starts at the
        end of the shorter text. A merge (u, v) moves it left only where u ends at the edge and
        v starts there, and then by the length of u; v must have grown, by earlier merges, from
        a symbol that started at the edge when it got there. ``reach[s]`` is the farthest that
        the edge can have come when the symbol s starts at it. One pass over the merges in rank
        order gives it: a merge starts from the farthest reach on v's left spine, and afterwards
        either the merged symbol or u alone, in the text where it wasn't merged, starts at the
        edge. No symbol that ends further left than the largest reach can differ.
        """
        size = lambda s: len(s.removesuffix(self.end)) if self.end and s != self.end else len(s)
        reach: dict[str, int] = {}
        made: dict[str, str] = {}
        most = 1
        for u, v in merges:
            far, s = 0, v
            while s is not None:
                far = max(far, reach.get(s, 0))
                s = made.get(s)
            far += size(u)
            made.setdefault(u + v, u)
            reach[u + v] = max(reach.get(u + v, 0), far)
            reach[u] = max(reach.get(u, 0), far)
            most = max(most, far)
        return most

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges in place: always the lowest rank, the leftmost place first."""
        rank, makes, none = self.rank, self.makes, 1 << 29
        if len(ids) <= 48:
            ranks = [rank[a].get(b, none) for a, b in zip(ids, ids[1:])]
            while ranks and (low := min(ranks)) != none:
                k = ranks.index(low)
                ids[k] = now = makes[low]
                del ids[k + 1], ranks[k]
                if k:
                    ranks[k - 1] = rank[ids[k - 1]].get(now, none)
                if k < len(ranks):
                    ranks[k] = rank[now].get(ids[k + 1], none)
            return ids
        n = len(ids)
        right, left = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(n - 1) if (r := rank[ids[k]].get(ids[k + 1], none)) != none]
        heapq.heapify(heap)
        while heap:
            low, k, a, b = heapq.heappop(heap)
            j = right[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j], right[k] = makes[low], -1, right[j]
            if right[j] >= 0:
                left[right[j]] = k
            for p, q in ((left[k], k), (k, right[k])):
                if p >= 0 and q >= 0 and (r := rank[ids[p]].get(ids[q], none)) != none:
                    heapq.heappush(heap, (r, p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def word(self, letters: str) -> list[int]:
        ids = [self.letter[c] for c in letters]
        ids[-1] = self.last[letters[-1]]
        return self.merge(ids)

    def of_bytes(self, raw: bytes) -> list[int]:
        """``word`` of a word's bytes."""
        byte = self.byte
        ids = [byte[b] for b in raw]
        ids[-1] = self.last_byte[raw[-1]]
        return self.merge(ids)

    def stream(self, letters: Iterator[str], window: int | None = None) -> Iterator[int]:
        """Tokens of one word, each as soon as it is stable.

        Holds at most ``window`` letters (by default four times the lookahead, 1024 at least).
        What is held starts at a token's start, and no merge crosses the end of a token, so the
        held letters can be merged by themselves; tokens that end ``lookahead`` letters or more
        before their end are stable.
        """
        window = max(4 * self.lookahead, 1024) if window is None else max(window, self.lookahead + 1)
        held: list[str] = []
        for letter in letters:
            if len(held) >= window:  # the word goes on, so none of these is its last letter
                done = 0
                for token in self.merge([self.letter[c] for c in held]):
                    if done + self.size[token] > len(held) - self.lookahead:
                        break
                    done += self.size[token]
                    yield token
                held = held[done:]
                if not done:
                    window *= 2  # a token longer than all that could be settled
            held.append(letter)
        if held:
            yield from self.word("".join(held))


class Decoder:
    """Byte-to-text state machine: takes tokens in any portions and gives text as it completes.

    ``spelt`` has each token's bytes, a space for a word end. Bytes of an unfinished character
    are the only state; bytes that aren't UTF-8 become U+FFFD, unknown tokens nothing.
    """

    def __init__(self, spelt: dict[int, bytes]):
        self.spelt, self.utf8 = spelt, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        spelt = self.spelt
        return self.utf8.decode(b"".join([spelt[i] for i in ids if i in spelt]))

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


class Joiner:
    """State machine for files without a decoder: tokens in any portions, joined by spaces.

    Whether a token has come before is the only state; unknown ids become nothing.
    """

    def __init__(self, token: dict[int, str]):
        self.token, self.begun = token, False

    def feed(self, ids: list[int]) -> str:
        token = self.token
        try:
            out = " ".join([token[i] for i in ids])
        except KeyError:
            ids = [i for i in ids if i in token]
            out = " ".join([token[i] for i in ids])
        if ids and self.begun:
            out = " " + out
        self.begun |= bool(ids)
        return out


class Memo:
    """A bounded memo in two halves: a full one becomes the older one, whose used entries move on."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key: str) -> tuple[int, ...] | None:
        got = self.old.get(key)
        if got is not None:
            self.put(key, got)
        return got

    def put(self, key: str, value: tuple[int, ...]) -> None:
        if len(self.new) >= self.size:
            self.old = self.new.copy()
            self.new.clear()  # the same dict stays the newer one
        self.new[key] = value

    def clear(self) -> None:
        self.new.clear()
        self.old = {}


class Encoder:
    """A vocabulary file's normaliser, splitter and merges, with a bounded memo of chunks.

    Chunks are what white space separates in normalised text: the pattern never matches across
    it, so each chunk is encoded by itself, whatever surrounds it.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] is not None or model.get("byte_fallback"):
            raise ValueError("a byte-level BPE file with word ends is needed")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.merges = MergeList(merges, self.vocab, self.end)
        self.letters = _byte_letters()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        own = {c: b for b, c in self.letters.items()}
        self.spelt = {
            i: b"".join([bytes([own[c]]) if c in own else c.encode() for c in t.removesuffix(self.end)]) + b" " * t.endswith(self.end)
            for t, i in self.vocab.items()
        } | {i: t.encode() + b" " for t, i in self.special.items()}
        self.decimal = {i: str(i) for i in self.token}
        marks = sorted(self.special, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        pattern = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pattern = _pattern(pattern)
        self.memo = Memo(MEMO_SIZE)

    def word_ids(self, word: str) -> tuple[int, ...]:
        raw = word.encode("utf-8", "surrogatepass")
        return tuple(self.merges.of_bytes(raw) if len(raw) <= 512 else self.merges.stream(iter(raw.decode("latin-1").translate(self.letters))))

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        """Tokens of a chunk that the memo's newer half doesn't have."""
        memo = self.memo
        got = memo.get(chunk)
        if got is not None:
            return got
        if chunk.isalpha() and (chunk.isascii() or not _FRESH.search(chunk)):
            got = self.word_ids(chunk)
        else:
            ids: list[int] = []
            for word in self.pattern.findall(chunk):
                # letters alone are a chunk as well, so the memo may know them
                ids += (memo.new.get(word) or self.chunk_ids(word)) if word != chunk and word.isalpha() else self.word_ids(word)
            got = tuple(ids)
        if len(chunk) <= MEMO_CHARS:
            memo.put(chunk, got)
        return got

    def _pieces(self, text: str) -> Iterator[tuple[str, bool]]:
        if self.marks is None or "<" not in text:
            yield text, False
        else:
            for k, part in enumerate(self.marks.split(text)):
                if part:
                    yield part, k % 2 == 1

    def portions(self, text: str) -> Iterator[list[int]]:
        """A text's tokens in portions of about ``PORTION``."""
        known, ids = self.memo.new, []
        for part, special in self._pieces(text):
            if special:
                ids.append(self.special[part])
                continue
            part = _normal(part)
            chunks = part.split() if not _ODD_SPACE.search(part) else _SPACE.split(part)
            for c in chunks:
                if c:
                    ids += known.get(c) or self.chunk_ids(c)
                    if len(ids) >= PORTION:
                        yield ids
                        ids = []
        if ids:
            yield ids

    def encode(self, text: str) -> list[int]:
        return [i for ids in self.portions(text) for i in ids]

    def digests(self, text: str) -> tuple[int, str, str]:
        """Number of tokens, and SHA-256 of the decimal ids and of the text that the ids decode to.

        Each portion of ids is read back by the decoding state machine; neither the ids nor the
        decoded text are held whole.
        """
        n, ids_hash, text_hash, machine, decimal = 0, hashlib.sha256(), hashlib.sha256(), Joiner(self.token), self.decimal
        for ids in self.portions(text):
            line = " ".join([decimal[i] for i in ids])
            ids_hash.update((" " + line if n else line).encode())
            text_hash.update(machine.feed(ids).encode())
            n += len(ids)
        return n, ids_hash.hexdigest(), text_hash.hexdigest()

    def decode(self, ids: list[int], plain: bool = False) -> str:
        """Tokens joined by spaces, as a file without a decoder says; ``plain``: readable text."""
        if not plain:
            return Joiner(self.token).feed(ids)
        machine = Decoder(self.spelt)
        return "".join([machine.feed(ids[k : k + 4096]) for k in range(0, len(ids), 4096)]) + machine.finish()

    def rest(self) -> None:
        """Forget the memo and free its memory at the end of a task."""
        self.memo.clear()
        release_memory()


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _replaced(docs: DataFrame, names: list[str]) -> DataFrame:
    return docs.select(*[c for c in docs.columns if c not in names])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with an array of token ids (null and empty texts: no ids). No shuffle.

    ``decoded`` names a further column for the text that the ids decode to, if wanted.
    """
    docs = _replaced(docs, [ids, decoded])
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    if decoded:
        schema = schema.add(decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                found = [encoder.encode(t.as_py() or "") for t in part.column(text)]
                cols = [*part.columns, pa.array(found, pa.list_(pa.int32()))]
                if decoded:
                    cols.append(pa.array([encoder.decode(x, plain=True) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)
        encoder.rest()

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded", plain: bool = True) -> DataFrame:
    """``docs`` with the text of an array of token ids (null: empty; unknown ids are left out)."""
    docs = _replaced(docs, [text])
    schema = T.StructType([*docs.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            out = pa.array([encoder.decode(x.as_py() or [], plain) for x in batch.column(ids)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, text])

    return docs.mapInArrow(run, schema)


def round_trip_digest(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``.

    Encodes each whole text and decodes its ids, portion by portion; only digests leave the task. Null counts as
    empty: no tokens and the digest of nothing, twice. Other columns stay behind.
    """
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    schema = f"_id {rows.schema['_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            n, ids, decoded = zip(*[encoder.digests(t.as_py() or "") for t in batch.column("_text")]) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        encoder.rest()

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", doc_id)
