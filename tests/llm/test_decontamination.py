import random
import re

from pyspark.sql import functions as F

from tidemark.llm import decontamination as d

ITEMS = "item_id long, text string"


def plain(text, items, window):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    w, hit, found = fold(text), set(), set()
    for item, t in items:
        v = fold(t)
        if not v:
            continue
        size = min(window, len(v))
        grams = {tuple(v[k : k + size]) for k in range(len(v) - size + 1)}
        for k in range(len(w) - size + 1):
            if tuple(w[k : k + size]) in grams:
                hit |= set(range(k, k + size))
                found.add("" if item is None else str(item))
    return len(w), hit, found


def test_automaton_equals_plain_search():
    rng = random.Random(1)
    for _ in range(150):
        text = lambda n: " ".join(rng.choice("ab cd e".split()) for _ in range(n))
        items = [(k, text(rng.randint(1, 9))) for k in range(rng.randint(1, 5))]
        auto = d.ItemAutomaton([(str(k), d.words(t.encode())) for k, t in items], 4)
        for _ in range(10):
            t = text(rng.randint(0, 25))
            n, hit, found = plain(t, items, 4)
            spans, got = auto.scan(d.words(t.encode()))
            assert {p for a, b in spans for p in range(a, b + 1)} == hit and got == found
            assert all(x[1] + 1 < y[0] for x, y in zip(spans, spans[1:]))


def test_frames(spark, odd_docs, no_docs):
    long = odd_docs.where("doc_id = 8").first().text
    words = long.split(" ")
    items = [(1, " ".join(words[20:40]).upper()), (2, "ONE two"), (None, None), (3, ""), (4, "!!"), (None, " ".join(words[50:58])), (1, "other text")]
    bench = spark.createDataFrame(items, ITEMS)
    for size in (1 << 20, 40):  # one automaton, and several
        out = d.scan_documents(odd_docs.withColumn("n_words", F.lit("old")), bench, item_bytes=size).collect()
        assert len(out) == odd_docs.count()
        for r in out:
            n, hit, found = plain(r.text, items, 10)
            assert r.n_words == n and {p for a, b in r.hit_spans for p in range(a, b + 1)} == hit and set(r.hit_items) == found
    assert d.digest(d.scan_documents(odd_docs, bench)).where("contaminated").count() == 3
    assert d.scan_documents(no_docs, bench).count() == 0
    assert d.digest(d.scan_documents(odd_docs, bench.limit(0))).where("n_hit > 0").count() == 0


def test_removal(spark, odd_docs, no_docs):
    words = odd_docs.where("doc_id = 8").first().text.split(" ")
    bench = spark.createDataFrame([(1, " ".join(words[20:40])), (2, "one two")], ITEMS)
    docs = odd_docs.withColumn("hit_spans", F.lit("own"))
    out = d.decontaminate(docs, bench)
    assert out.columns == docs.columns
    left = {r.doc_id: r for r in out.collect()}
    assert 6 not in left and 7 not in left and left[8].hit_spans == "own"  # wholly hit: gone
    assert left[8].text == " ".join(words[:20]) + "  " + " ".join(words[40:])
    same = odd_docs.where("doc_id NOT IN (6, 7, 8) OR doc_id IS NULL")
    assert out.drop("hit_spans").where("doc_id <> 8 OR doc_id IS NULL").exceptAll(same).count() == 0
    assert out.count() == odd_docs.count() - 2
    assert d.decontaminate(no_docs, bench).count() == 0
