import random
import re

from pyspark.sql import functions as F

from tidemark.llm import licenses
from tidemark.llm.license_rules import BASE

RULES = licenses.read_rules()
INNER = [r.pattern.pattern.decode().removeprefix("(?<![^ ])(?:").removesuffix(")(?![^ ])") for r in RULES]


def plain(text):
    """Every rule on every text, each match against each other, word by word."""
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    joined = " ".join(words)
    number = lambda at: joined[:at].count(" ")
    base = [(k, label) for phrase, label in BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    found = [(m.start(), m.end(), k) for k, p in enumerate(INNER) for m in re.finditer("(?<![^ ])(?:" + p + ")(?![^ ])", joined) if m.group()]
    kept = [x for x in found if not any(y[2] < x[2] and y[0] <= x[0] and x[1] <= y[1] for y in found)]
    kept = sorted(x for x in kept if RULES[x[2]].label != "-")
    base_labels, starts = {x for _, x in base}, [k for k, _ in base]
    score = 1.0
    for s in [0.9] * len(base_labels) + [RULES[k].strength for k in sorted({x[2] for x in kept})]:
        score *= 1 - s
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)),
        ",".join(sorted(base_labels | {RULES[x[2]].label for x in kept})), min(1.0, 1 - score),
        [(RULES[k].label, k, number(a), number(b - 1)) for a, b, k in kept],
    )


def as_plain(row):
    return (*row[:-1], [tuple(x.values()) if isinstance(x, dict) else tuple(x) for x in row[-1]])


def some_texts(n=150):
    rng = random.Random(4)
    vocab = sorted({w for p in INNER for w in re.findall(r"(?<![\\\w])[a-zé0-9]+", p)})
    lines = ["Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "GNU General Public License v3", "MIT License", "not licensed under the MIT license",
             "compatible with the GNU General Public License", "dual licensed under the MIT license or the Apache License 2.0", "Copyright (c) 2020 A. B. All rights reserved"]
    for _ in range(n):
        yield rng.choice((" ", "\n", ", ")).join(rng.choice((rng.choice(lines), rng.choice(vocab), rng.choice(vocab).upper(), "und", "x")) for _ in range(rng.randint(0, 60)))


def test_equals_trying_every_rule():
    scanner = licenses.Scanner()
    for text in [*some_texts(), None, "", " \n", "é" * 50, "MIT License " * 300, "cc\x00BY-cc.by", "gnu general public"]:
        assert as_plain(scanner.scan(text)) == plain(text), text


def example(tree, rng):
    """A random text that a parsed pattern matches."""
    out = ""
    for op, arg in tree:
        match str(op):
            case "LITERAL":
                out += chr(arg)
            case "NOT_LITERAL":
                out += "x"
            case "IN":
                kind, value = rng.choice(arg)
                out += "x" if str(arg[0][0]) == "NEGATE" else chr(value) if str(kind) == "LITERAL" else "7"
            case "BRANCH":
                out += example(rng.choice(arg[1]), rng)
            case "SUBPATTERN":
                out += example(arg[-1], rng)
            case "MAX_REPEAT":
                out += "".join(example(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
            case other:
                raise ValueError(other)
    return out


def test_hundreds_of_rules_each_with_its_keyword():
    assert len(RULES) >= 250
    rng, gate, shut = random.Random(2), licenses.Gate(RULES), set()
    for rule, pattern in zip(RULES, INNER):
        tree = re._parser.parse(pattern)
        for _ in range(30):
            text = example(tree, rng)
            assert re.fullmatch(pattern, text), (pattern, text)
            if rule not in gate.open_for(text.encode().split()):
                shut.add((rule.label, rule.keywords, text))
    assert not shut


def test_priority_and_guards():
    scan = lambda t: {x["label"] for x in licenses.Scanner().scan(t)[-1]}
    assert scan("Licensed under the Apache License, Version 2.0") == {"apache-2.0"}
    assert scan("GNU Lesser General Public License v2.1 or later") == {"lgpl-2.1-or-later"}
    assert scan("It is compatible with the GNU General Public License.") == set()
    assert scan("SPDX-License-Identifier: MIT") == {"mit"}
    assert scan("a driver's license") == set()
    assert scan("CC BY-SA 3.0 and CC-BY") == {"cc-by-sa-3.0", "cc-by"}


def test_suppression_against_all_pairs():
    rng = random.Random(9)
    for _ in range(300):
        found = []
        for _ in range(rng.randint(0, 25)):
            a = rng.randint(0, 20)
            found.append(licenses.Found(a, a + rng.randint(1, 9), RULES[rng.randint(0, 5)]))
        found = list({(x.start, x.stop, x.rule.rank): x for x in found}.values())
        rank = {x: (x.rule.rank, x.start, -x.stop) for x in found}
        want = [x for x in found if not any(y is not x and y.start <= x.start and x.stop <= y.stop and (rank[y] < rank[x]) for y in found)]
        assert licenses.without_contained(found) == sorted(want)


def test_frames(spark, odd_docs, no_docs):
    extra = odd_docs.withColumns({"score": F.lit(-1), "labels": F.lit("x"), "n_words": F.lit("y"), "rule": F.lit(1)})
    out = licenses.scan_licenses(extra, spans="spans")
    texts = [r.text for r in odd_docs.collect()]
    cols = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    assert sorted([as_plain(tuple(r)) for r in out.select(cols).collect()], key=str) == sorted(map(plain, texts), key=str)
    assert "rule" in out.columns and "text" not in out.columns and out.columns.count("score") == 1
    assert licenses.scan_licenses(no_docs).count() == 0


def test_query(spark, tmp_path):
    from tidemark.llm.queries import op13_licenses

    rows = list(enumerate(some_texts(40))) + [(None, "MIT License"), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_licenses(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(i, *plain(t)[:-1]) for i, t in rows], key=str)
