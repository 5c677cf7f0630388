"""Nearest vectors, phrases and lexical search against plain versions, with tiles, tries and blocks of a few rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from curvespace.llm import lexical, nearest, phrases, queries


def read(folder, name, *cols):
    t = pq.read_table(f"{folder}/{name}.parquet").select(cols)
    return list(zip(*(t.column(c).to_pylist() for c in cols), strict=True))


def rows_of(df, *cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture(params=["case", "small"])
def folder(request, small):
    return request.getfixturevalue("case")[0] if request.param == "case" else small


# ---- nearest vectors ---------------------------------------------------------------------------------------------------


def cosines(rows, every=50, k=5):
    good = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    dot = lambda a, b: float(sum(np.float64(x) * np.float64(y) for x, y in zip(a, b, strict=True)))
    length = {r: math.sqrt(dot(r[1], r[1])) for r in good}
    out = {}
    for q in good:
        if q[0] % every == 0:
            out.setdefault(q[0], []).extend((-dot(q[1], c[1]) / (length[q] * length[c]), c[0]) for c in good if c[0] != q[0] and len(c[1]) == len(q[1]))
    return Counter((q, r, i, -s) for q, own in out.items() for r, (s, i) in enumerate(sorted(own)[:k], 1))


def test_nearest(spark, folder):
    got = rows_of(queries.QUERIES["op11_nearest"](spark, folder), "query_id", "rank", "vec_id", "score")
    assert got == cosines(read(folder, "embeddings", "vec_id", "embedding"))


def test_nearest_in_small_tiles(spark, monkeypatch):
    """Clusters closer than the rounding to int8, one vector that a third of the rows share, one id with two vectors, lengths that differ."""
    monkeypatch.setattr(nearest, "TILE", 16)
    monkeypatch.setattr(nearest, "PANEL", 2)
    rng = random.Random(4)
    centre = [rng.gauss(0, 1) for _ in range(12)]
    rows = [(k, [x + rng.gauss(0, 1e-4) for x in centre]) for k in range(150)] + [(k, centre) for k in range(150, 300)] + [(k, [rng.gauss(0, 1) for _ in range(12)]) for k in range(300, 450)]
    rows += [(50, [1.0] * 12), (500, [1.0, 2.0]), (550, [2.0, 1.0]), (551, [0.0] * 12), (552, [1e-300] * 12), (None, centre)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = rows_of(nearest.nearest(df, F.col("vec_id") % 50 == 0), "query_id", "rank", "vec_id", "score")
    assert got == cosines([r for r in rows if r[0] != 552])


def test_bounds_leave_few_pairs(small):
    ids, v = zip(*read("/root/testdata/sf0.1", "embeddings", "vec_id", "embedding"), strict=True)
    ids, v = np.array(ids), np.array(v, "<f4")
    heaps = nearest.Heaps(nearest.Tile.of(ids[:50], v[:50]), 5)
    for lo in range(0, len(ids), 1000):
        heaps.meet(nearest.Tile.of(ids[lo : lo + 1000], v[lo : lo + 1000]))
    assert heaps.rescored < 0.1 * heaps.pairs


# ---- phrases -----------------------------------------------------------------------------------------------------------


def collocations(rows, least=10, top=2000, words=3):
    tries = {}
    for lang, text in rows:
        c = tries.setdefault("und" if lang is None else lang, Counter())
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            c.update(tuple(w[i : i + d]) for d in range(1, words + 1) for i in range(len(w) - d + 1))
    out = []
    for lang, c in tries.items():
        n, best, longer = sum(v for p, v in c.items() if len(p) == 1), [], Counter()
        many = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in many.items():
            for d in range(2, len(p)):
                for i in range(len(p) - d + 1):
                    longer[p[i : i + d]] = max(longer[p[i : i + d]], a)
        for p, a in many.items():
            if 100 * longer[p] < 50 * a:
                s, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                best.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n, -s) for r, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return Counter(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_phrases(spark, folder):
    assert rows_of(queries.QUERIES["op12_phrases"](spark, folder), *COLUMNS) == collocations(read(folder, "documents", "lang", "text"))


@pytest.mark.parametrize("words", [3, 4])
@pytest.mark.parametrize("limit", [7, 40])
def test_phrases_over_the_borders_of_tries_and_ranges(spark, monkeypatch, words, limit):
    monkeypatch.setattr(phrases, "WORDS", limit)
    monkeypatch.setattr(phrases, "RANGE", 300)
    monkeypatch.setattr(phrases, "STEP", 25)
    rng = random.Random(limit)
    vocabulary = ["a", "A", "b", "of", "the", "é", "\x01", "東京", "long" * 9, "x\x7f"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ". ", "\r\n", "  ", "!"]) for _ in range(n))
    rows = [(rng.choice(["en", "de", None, "und"]), rng.choice([None, "", text(1), text(30), text(30)])) for _ in range(120)] + [("en", "of the " * 400), ("xx", "y" * 500)]
    df = spark.createDataFrame(rows, "lang string, text string").withColumn("phrase", F.lit(1)).repartition(3)
    got = rows_of(phrases.collocations(df, words=words, least=4, top=60), *COLUMNS)
    want = collocations(rows, 4, 60, words)
    assert got == want, (sorted(got - want)[:4], sorted(want - got)[:4])


def test_no_phrases(spark):
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "..."), ("en", "a b c")], "lang string, text string")).count() == 0


def test_score_is_exact_beyond_64_bits(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(200):
        a = rng.randrange(1, 10**rng.randrange(1, 15))
        rows.append((a, a + rng.randrange(10**rng.randrange(1, 15)), a + rng.randrange(10**rng.randrange(1, 15))))
    df = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", F.expr(phrases.cut_score("a", "l", "r")))
    assert all(x.s == 1_000_000 * x.a * x.a // (x.l * x.r) for x in df.collect())


# ---- lexical search ------------------------------------------------------------------------------------------------------


def terms(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or ""))


def ranking(docs, items, k=20):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df, asked = Counter(t for _, c in counts for t in c), {}
    for i, t in {x for x in items if x[0] is not None}:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c in counts:
            if i is not None and c:
                m = 75 + 25 * c.total() * n // total
                s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t, q in own.items() if c[t])
                if s > 0:
                    scored.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return Counter(out)


def test_lexical(spark, folder):
    got = rows_of(queries.QUERIES["op13_lexical"](spark, folder), "item_id", "rank", "doc_id", "score")
    assert got == ranking(read(folder, "documents", "doc_id", "text"), read(folder, "benchmark", "item_id", "text"))


@pytest.mark.parametrize("most", [1 << 18, 0])
def test_lexical_in_small_blocks(spark, monkeypatch, most):
    """A word of all documents, ties, copies, textual ids; with and without the terms at hand in all tasks."""
    for name, v in (("MOST_TERMS", most), ("POSTINGS", 300), ("ITEMS", 2)):
        monkeypatch.setattr(lexical, name, v)
    rng = random.Random(9)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    docs = [(f"d{k:03}", "The " + " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for k in range(300)] + [(f"e{k:03}", "the same w1 w2") for k in range(150)]
    docs += [(None, "w1 w1 w1 w2 w3"), (None, "w1 w1 w1 w2 w3"), ("z", None), ("y", ""), ("x", "-- ..")] + docs[:5]
    items = [(f"i{k}", " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for k in range(7)] + [("i1", "w1 w1 w2"), ("i2", None), ("none", "unheard of"), ("null", None), (None, "w1"), ("all", "the")]
    got = lexical.search(spark.createDataFrame(docs, "doc_id string, text string").withColumn("n", F.lit(1)), spark.createDataFrame(items + items[:2], "item_id string, text string"), k=6)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == ranking(docs, items, 6)


def test_floors_rule_out_terms():
    """Fewer documents are scored than hold a term of an item, and what a floor leaves out lies below it."""
    folder = "/root/testdata/sf0.01"
    docs, items = read(folder, "documents", "doc_id", "text"), read(folder, "benchmark", "item_id", "text")
    counts = [Counter(terms(t)) for _, t in docs]
    n, total, df = sum(map(bool, counts)), sum(c.total() for c in counts), Counter(t for c in counts for t in c)
    flat = [(t.encode(), v) for c in counts for t, v in c.items()]
    block = lexical.Block(np.array([i for i, _ in docs]), np.array([c.total() for c in counts]), np.array([len(c) for c in counts]), pa.array([t for t, _ in flat]), np.array([v for _, v in flat]), n, total)
    scored = holders = 0
    for _, text in items:
        asked = []
        for t, q in Counter(terms(text)).items():
            if (s := block.postings(t.encode())) is not None:
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                adds = sorted((int(x) * q * w for x in block.each[s]), reverse=True)
                asked.append({"term": t.encode(), "q": q, "w": w, "most": adds[0], "kth": adds[19] if len(adds) >= 20 else 1})
        floor, rest = max(1, *(a["kth"] for a in asked)), 0
        for a in sorted(asked, key=lambda a: a["most"]):
            rest += a["most"]
            a["lead"] = rest >= floor
        before = block.candidates
        rows, score = block.search(asked, floor, 20)
        scored, before = scored + block.candidates - before, block.candidates
        all_rows, all_scores = block.search([{**a, "lead": True} for a in asked], 1, 20)
        holders += block.candidates - before
        assert (rows.tolist(), score.tolist()) == (all_rows.tolist(), all_scores.tolist())
    assert scored < 0.8 * holders, (scored, holders)
