"""Phrase collocations: depth-limited count tries of shards, serialised in order and merged by prefix range."""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curvespace.llm.common import forget, join_spread, keep, ready

#: Words of one trie: what a task counts before it writes its nodes out.
WORDS = 1 << 20
#: Bytes of text for one prefix range, and most ranges (beyond which ranges grow); sampled phrases for each border.
RANGE, RANGES, DRAWN = 1 << 22, 1 << 16, 16
#: Shares of a language that are ranked by themselves first.
SHARES = 16
#: Bytes of a text split into words at once.
STEP = 1 << 20

#: Only A-Z are lower-cased; what ends a piece becomes a line feed, a tab a space.
_BYTES = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

Phrase = tuple[bytes, ...]


def runs(text: bytes) -> Iterator[tuple[list[bytes], bool]]:
    """The words of a text's pieces in order, at most about ``STEP`` bytes at once; true where the piece ends."""
    for piece in text.translate(_BYTES).split(b"\n"):
        at = 0
        while len(piece) - at > STEP:
            cut = piece.rfind(b" ", at + 1, at + STEP)
            if cut < 0 and (cut := piece.find(b" ", at + STEP)) < 0:
                break
            yield piece[at:cut].split(), False
            at = cut
        yield piece[at:].split(), True


class _Ids(dict):
    """Numbers of words from 1, in the order met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def lower_bound(phrase: Phrase, words: list[bytes], depth: int, bits: int) -> int:
    """The least packed key, over sorted ``words``, that is not below ``phrase``."""
    key = 0
    for k, w in enumerate(phrase):
        at = bisect_left(words, w)
        key |= (at + 1) << (bits * (depth - 1 - k))
        if at == len(words) or words[at] != w:
            break
    return key


class Trie:
    """Counts of all phrases of up to ``depth`` words of a stream. Nodes are phrases in the order of their words, a phrase
    right before those that it begins: one packed key each, a number of the sorted words for each place, 0 after the end."""

    def __init__(self, depth: int, before: list[bytes] = ()):
        self.depth, self.ids = depth, _Ids()
        self.stream = [self.ids[w] for w in before]
        self.carried = len(self.stream)

    def add(self, words: list[bytes], ends: bool) -> None:
        self.stream += map(self.ids.__getitem__, words)
        if ends and self.stream and self.stream[-1]:
            self.stream.append(0)

    def tail(self) -> list[bytes]:
        """The last words of a piece that goes on: where the next trie begins."""
        back = {v: k for k, v in self.ids.items()}
        last: list[bytes] = []
        for i in reversed(self.stream[-(self.depth - 1) :] if self.depth > 1 else []):
            if not i:
                break
            last.append(back[i])
        return last[::-1]

    def nodes(self) -> tuple[list[bytes], int, np.ndarray, np.ndarray]:
        """Sorted words, bits for a place, sorted keys and their counts."""
        words = sorted(self.ids)
        place = np.zeros(len(words) + 1, np.int64)
        place[[self.ids[w] for w in words]] = np.arange(1, len(words) + 1)
        a, bits = place[np.array(self.stream, np.int64)] if self.stream else np.zeros(0, np.int64), (len(words) + 1).bit_length()  # room for "after all words"
        keys, counts = [], []
        for d in range(1, self.depth + 1):
            first = max(0, self.carried - d + 1)
            n = len(a) - d + 1
            if n <= first:
                continue
            packed, whole = np.zeros(n - first, np.int64), np.ones(n - first, bool)
            for k in range(d):
                own = a[first + k : n + k]
                packed |= own << (bits * (self.depth - 1 - k))
                whole &= own > 0
            u, c = np.unique(packed[whole], return_counts=True)
            keys.append(u)
            counts.append(c)
        every, many = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
        order = np.argsort(every, kind="stable")
        return words, bits, every[order], many[order]

    def parts(self, borders: list[Phrase]) -> Iterator[tuple[int, bytes, bytes]]:
        """``part, words, nodes`` of each prefix range that the trie reaches into, serialised in order. A range also gets the nodes
        that begin its border, from every trie that has them, so that walks from its first nodes find what they pass."""
        words, bits, keys, counts = self.nodes()
        at = [0, *np.searchsorted(keys, [lower_bound(b, words, self.depth, bits) for b in borders]).tolist(), len(keys)] if borders else [0, len(keys)]
        for part, (lo, hi) in enumerate(zip(at, at[1:], strict=False)):
            own = np.arange(lo, hi)
            if part:
                begin = [lower_bound(borders[part - 1][:d], words, self.depth, bits) for d in range(1, len(borders[part - 1]))]
                up = np.searchsorted(keys, begin)
                up = [int(u) for u, b, d in zip(up, begin, range(1, self.depth), strict=False) if u < lo and keys[u] == b and all(w in self.ids for w in borders[part - 1][:d])]
                own = np.concatenate([np.array(up, np.int64), own])
            if len(own):
                yield part, *packed_nodes(words, bits, self.depth, keys[own], counts[own])


def packed_nodes(words: list[bytes], bits: int, depth: int, keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    places = [keys >> (bits * (depth - 1 - k)) & ((1 << bits) - 1) for k in range(depth)]
    used = np.unique(np.concatenate([*places, [0]]))
    own = [np.searchsorted(used, p).astype("<i4") for p in places]
    own[0] = np.diff(own[0], prepend=np.int32(0)).astype("<i4")
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return squeeze(b"\n".join(words[i - 1] for i in used[1:].tolist())), squeeze(b"".join([*[p.tobytes() for p in own], counts.astype("<i8").tobytes()]))


def unpacked_nodes(depth: int, words: bytes, nodes: bytes) -> tuple[list[bytes], list[np.ndarray], np.ndarray]:
    open_ = zstandard.ZstdDecompressor().decompress
    raw = open_(nodes)
    n = len(raw) // (4 * depth + 8)
    places = [np.frombuffer(raw, "<i4", n, 4 * n * k).astype(np.int64) for k in range(depth)]
    places[0] = np.cumsum(places[0])
    return open_(words).split(b"\n"), places, np.frombuffer(raw, "<i8", n, 4 * n * depth)


def merged(tries: list[tuple[list[bytes], list[np.ndarray], np.ndarray]], depth: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words in order, nodes (a line for each place) in order and their summed counts, of several tries."""
    words = sorted(set().union(*[t[0] for t in tries]))
    number = {w: i + 1 for i, w in enumerate(words)}
    own = [np.array([0, *[number[w] for w in t[0]]], np.int64) for t in tries]
    places = np.stack([np.concatenate([o[t[1][k]] for o, t in zip(own, tries, strict=True)]) for k in range(depth)])
    counts = np.concatenate([t[2] for t in tries])
    bits = len(words).bit_length()
    if depth * bits <= 63:  # the keys of each trie are in order: the stable sort merges these runs
        order = np.argsort(sum(p << (bits * (depth - 1 - k)) for k, p in enumerate(places)), kind="stable")
    else:
        order = np.lexsort(places[::-1])
    places, counts = places[:, order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(places, axis=1) != 0).any(axis=0)]))
    return words, places[:, first], np.add.reduceat(counts, first)


def _tokens(rows: DataFrame, depth: int, borders) -> DataFrame:
    """``lang, part, words, nodes``: the tries of each input partition of ``rows(lang, text)``."""
    limit = min(WORDS, 2 ** (63 // depth) - 1 - depth)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts: dict[str, list[Phrase]] = borders.value
        tries: dict[str, Trie] = {}
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, trie in tries.items():
                for part, words, nodes in trie.parts(cuts.get(lang, [])):
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "part": pa.array([part], pa.int32()), "words": pa.array([words], pa.binary()), "nodes": pa.array([nodes], pa.binary())})

        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                lang = lang.as_py()
                for words, ends in runs(text.as_py()):
                    for lo in range(0, max(1, len(words)), limit):
                        some, last = words[lo : lo + limit], lo + limit >= len(words)
                        if held + len(some) > limit:
                            yield from out()
                            before = tries[lang].tail() if lang in tries else []
                            tries, held = {lang: Trie(depth, before)}, 0
                        tries.setdefault(lang, Trie(depth)).add(some, ends and last)
                        held += len(some)
        yield from out()

    return rows.mapInArrow(count, "lang string, part int, words binary, nodes binary")


def _borders(rows: DataFrame, depth: int) -> dict[str, list[Phrase]]:
    """Where prefix ranges begin, by language: quantiles of phrases drawn by hash, one for each ``RANGE`` bytes of text
    and ``RANGES`` at most. They only decide how evenly the work is dealt, never what is counted; the driver holds
    ``DRAWN`` phrases for each."""
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = min(RANGES, total // RANGE)
    if not ranges:
        return {}
    wanted = ranges * DRAWN
    thin = max(1, min(1 << 16, total // (8 * wanted)))  # a word and its space take some 8 bytes: so many phrases there are for each wanted
    docs = max(1, int(thin**0.5))  # both texts and their phrases are thinned
    each = max(1, thin // docs)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1), strict=True):
                got = set()
                for words, _ in runs(text.as_py()):
                    got |= {p for i in range(len(words)) if zlib.crc32(p := b" ".join(words[i : i + depth])) % each == 0}
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang.as_py()] * len(got), pa.string()), "phrase": pa.array(sorted(got), pa.binary())})

    drawn = rows.filter(F.pmod(F.xxhash64("text"), F.lit(docs)) == 0).mapInArrow(draw, "lang string, phrase binary").distinct()
    few = drawn.orderBy(F.xxhash64("lang", "phrase")).limit(wanted).collect()
    cuts = sorted((r.lang, tuple(bytes(r.phrase).split(b" "))) for r in few)
    out: dict[str, list[Phrase]] = {}
    for k in range(1, ranges):
        if cuts and (not (own := out.setdefault((at := cuts[k * len(cuts) // ranges])[0], [])) or own[-1] != at[1]):
            own.append(at[1])
    return out


def counted(docs: DataFrame, words: int = 3, least: int = 10, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, d, phrase, f, lefts, rests, inner``: every phrase of up to ``words`` words that occurs ``least`` times, its number
    of words, how often it occurs, how often its first 1, 2, ... words do, and, for phrases of two words or more, what
    follows these, and its shorter phrases of two words or more. A row of ``d`` = 0 holds how many words a part of a language has."""
    spark = ready(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    borders = spark.sparkContext.broadcast(_borders(rows, words))

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        name, part = key[0].as_py(), key[1].as_py()
        tries = [unpacked_nodes(words, w.as_py(), n.as_py()) for w, n in zip(table.column("words"), table.column("nodes"), strict=True)]
        every, places, counts = merged(tries, words)
        depth = (places > 0).sum(axis=0)
        own = np.ones(len(counts), bool)
        if part:  # what lies before the border is there for the walk only
            border = borders.value[name][part - 1]
            equal = own.copy()
            for k in range(words):
                at = bisect_left(every, border[k]) if k < len(border) else 0
                there = k < len(border) and at < len(every) and every[at] == border[k]
                low = at + 1 if k < len(border) else 0
                own &= ~(equal & (places[k] < low))
                equal &= (places[k] == low) if there or k >= len(border) else False
        total = int(counts[own & (depth == 1)].sum())
        many = counts >= least
        places, counts, depth, own = places[:, many], counts[many], depth[many], own[many]
        at = np.arange(len(counts))
        up = [np.maximum.accumulate(np.where(depth == d, at, -1)) if len(at) else at for d in range(1, words)]
        phrases, fs, ds, lefts, rests, inner = [b""], [total], [0], [[]], [[]], [[]]
        for i in np.flatnonzero(own).tolist():
            d = int(depth[i])
            w = [every[p - 1] for p in places[:d, i].tolist()]
            phrases.append(b" ".join(w))
            fs.append(int(counts[i]))
            ds.append(d)
            lefts.append([int(counts[up[k][i]]) for k in range(d - 1)])
            rests.append([b" ".join(w[k:]) for k in range(1, d)])
            inner.append([b" ".join(w[k : k + n]) for n in range(2, d) for k in range(d - n + 1)])
        some = lambda x: pa.array(x, pa.list_(pa.binary()))
        return pa.table({"lang": pa.array([name] * len(fs), pa.string()), "d": pa.array(ds, pa.int32()), "phrase": pa.array(phrases, pa.binary()), "f": pa.array(fs, pa.int64()), "lefts": pa.array(lefts, pa.list_(pa.int64())), "rests": some(rests), "inner": some(inner)})

    shards = _tokens(rows, words, borders)
    return shards.groupBy("lang", "part").applyInArrow(merge, "lang string, d int, phrase binary, f long, lefts array<long>, rests array<binary>, inner array<binary>")


def cut_score(a: str, left: str, rest: str, scale: int = 1_000_000) -> str:
    """SQL of floor(scale * a * a / (left * rest)), exact while a stays below 10**16."""
    wide = "CAST({} AS DECIMAL(38, 0))".format
    return f"CAST(({wide(scale)} * {wide(a)} * {wide(a)}) DIV ({wide(left)} * {wide(rest)}) AS BIGINT)"


def collocations(docs: DataFrame, words: int = 3, least: int = 10, top: int = 2000, covered: int = 50, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: of each language the first ``top`` phrases of 2 to ``words`` words that occur
    at least ``least`` times.

    Texts are cut into pieces at ``. , ; : ! ?`` and line ends and these into words at spaces and tabs; only A-Z are lower-cased.
    Phrases lie within a piece, overlapping ones count. Of a phrase's cuts into two the one of lowest score
    floor(10**6 * a * a / (l * r)) counts, the first of equals; a phrase goes whose words lie inside a longer one that is
    found at least ``covered`` percent as often. Ties by ``a`` falling, then phrase. Null languages are ``und``, null texts
    empty; repeated rows count as often as they occur; other columns are ignored; no rows: no rows.

    Each task counts its texts in tries of at most ``WORDS`` words and writes their nodes out in order, cut at the borders of
    prefix ranges; a range's parts are merged in one task, where a node's left parts are those passed on the walk to it. Right
    parts are reached by joins with the nodes of the remaining words; words in which many phrases end are spread.
    """
    nodes = keep(counted(docs, words, least, lang, text))
    totals = nodes.filter("d = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    part = F.struct("lang", "phrase").alias("part")
    found = nodes.filter("d >= 2").select("lang", "phrase", F.col("f").alias("a"), F.posexplode(F.arrays_zip("lefts", "rests")).alias("k", "cut"))
    links = keep(found.select("lang", "phrase", "a", "k", F.col("cut.lefts").alias("l"), F.struct("lang", F.col("cut.rests").alias("phrase")).alias("part")))
    asked = links.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    ends = keep(nodes.filter(f"d BETWEEN 1 AND {words - 1}").select(part, F.col("f").alias("r")).join(asked, "part"))
    cuts = join_spread(links, ends, "part").withColumn("score", F.expr(cut_score("a", "l", "r")))
    low = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("low"))
    over = nodes.filter("d >= 3").select("lang", F.explode("inner").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = low.join(over, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("low.score"), F.desc("a"), "phrase"))
    # a language may hold most phrases: the first of each of some shares of it come before the first of all
    some = left.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES))).withColumn("rank", rank("lang", "share")).filter(F.col("rank") <= top)
    best = keep(some.withColumn("rank", rank("lang")).filter(F.col("rank") <= top))
    rows = best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "low.l", "low.r", "n", "low.score")
    rows = keep(rows)
    forget(nodes, links, ends, best)
    return rows


def oracle(least: int = 10, top: int = 2000) -> str:
    """DuckDB SQL for the registered query."""
    return f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p
), g AS MATERIALIZED (
  SELECT lang, unnest(w) AS x, unnest(list_concat(w[2:], [NULL])) AS y, unnest(list_concat(w[3:], [NULL, NULL])) AS z FROM w WHERE len(w) > 0
), f1 AS MATERIALIZED (
  SELECT lang, x, count(*) AS f FROM g WHERE x IS NOT NULL GROUP BY ALL
), f2 AS MATERIALIZED (
  SELECT lang, x, y, count(*) AS f FROM g WHERE y IS NOT NULL GROUP BY ALL
), f3 AS MATERIALIZED (
  SELECT lang, x, y, z, count(*) AS f FROM g WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}
), cut AS (
  SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, 1 AS k, l.f AS l, r.f AS r
  FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.x = f2.x JOIN f1 r ON r.lang = f2.lang AND r.x = f2.y WHERE f2.f >= {least}
  UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || z, f3.f, 1, l.f, r.f FROM f3 JOIN f1 l ON l.lang = f3.lang AND l.x = f3.x JOIN f2 r ON r.lang = f3.lang AND r.x = f3.y AND r.y = f3.z
  UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || z, f3.f, 2, l.f, r.f FROM f3 JOIN f2 l ON l.lang = f3.lang AND l.x = f3.x AND l.y = f3.y JOIN f1 r ON r.lang = f3.lang AND r.x = f3.z
), low AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS o FROM (SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cut)) WHERE o = 1
), longer AS (
  SELECT lang, phrase, max(f) AS f FROM (SELECT lang, x || ' ' || y AS phrase, f FROM f3 UNION ALL SELECT lang, y || ' ' || z, f FROM f3) GROUP BY lang, phrase
), ranked AS (
  SELECT low.lang, low.phrase, a, l, r, score, row_number() OVER (PARTITION BY low.lang ORDER BY score DESC, a DESC, low.phrase) AS rank
  FROM low LEFT JOIN longer ON longer.lang = low.lang AND longer.phrase = low.phrase WHERE longer.f IS NULL OR 100 * longer.f < 50 * a
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang
)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n ON n.lang = ranked.lang WHERE rank <= {top}"""
