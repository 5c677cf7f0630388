"""Best-fit packing of token sequences by a grouping genetic algorithm on islands."""

from __future__ import annotations

import json
import random
import re
import zlib
from array import array
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from curvespace.llm.common import forget, free_name, keep, ranked, ready, tagged

#: Words whose ids a worker remembers; beyond it those used again since the last time are kept first.
REMEMBERED = 300_000

_SAFE = re.compile(r"(?<=\S) ")

# The byte-level BPE's way to show bytes as letters.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SHOWN = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PLAIN)}


#: The pre-tokens, under the byte-level BPE's own pattern, of text that holds nothing but letters beyond ASCII.
_PARTS = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[A-Za-z\x80-\U0010ffff]+| ?[0-9]+| ?[^\sA-Za-z0-9\x80-\U0010ffff]+|\s+(?!\S)|\s+", re.ASCII)
#: What is left without these are digits and characters beyond ASCII.
_MARKS = re.compile(r"[\x00-\x2f\x3a-\x7f]+")


class _Shown(dict):
    """Characters as the letters of their UTF-8 bytes."""

    def __missing__(self, c: str) -> str:
        shown = self[c] = c.encode().decode("latin-1").translate(_SHOWN)
        return shown


class _Parts(dict):
    """Ids of single pre-tokens."""

    def __init__(self, words: WordIds):
        self.words, self.model, self.shown = words, words.model, _Shown()

    def new(self, part: str) -> bytes:
        shown = part.translate(_SHOWN) if part.isascii() else "".join(map(self.shown.__getitem__, part))
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def __missing__(self, part: str) -> bytes:
        if part[0] == " " and (ids := self.words.get(part[1:])):
            return ids
        if len(self) >= REMEMBERED // 4:
            self.clear()
        ids = self.new(part)
        if len(part) <= 64:
            self[part] = ids
        return ids


class WordIds(dict):
    """Token ids (little-endian unsigned 32-bit bytes) of pieces of text that start with a space.

    For byte-level BPE without a normalizer, a text may be cut before any space that follows a character other than white space: the tokenizer's
    pre-token pattern never crosses such a place and looks at nothing before it. So the ids of a text are those
    of its pieces, and a piece met before need not be encoded again. ASCII pieces, and those of letters and ASCII marks, are cut into their
    pre-tokens here, unless a token that was added to the vocabulary is in them. Texts of any other tokenizer are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts, self.former = _Parts(self), {}
        made = json.loads(self.tokenizer.to_str())
        added = [re.escape(t["content"]) for t in made["added_tokens"]]
        self.added = re.compile("|".join(added)).search if added else lambda piece: None
        cut = made["pre_tokenizer"] or {}
        self.by_pieces = made["model"]["type"] == "BPE" and made["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut["add_prefix_space"]

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[-1].isspace():
            raise LookupError  # the space after it is no place to cut
        if len(self) >= REMEMBERED:
            self.former = dict(self)
            self.clear()
        ids = self.former.get(piece)
        if ids is None:
            ids = self.new(piece)
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def new(self, piece: str) -> bytes:
        word = piece.rstrip(".,")
        if len(word) < len(piece) and word.isalpha():
            return self[word] + self.parts[piece[len(word) :]]
        if word.isalpha():
            if piece.isascii():
                return array("I", [t.id for t in self.model.tokenize("Ġ" + piece)]).tobytes()
            return self.parts.new(" " + piece)
        return self.cut(" " + piece)

    def cut(self, text: str) -> bytes:
        if (text.isascii() or _MARKS.sub("", text).isalpha()) and not self.added(text):
            return b"".join(map(self.parts.__getitem__, _PARTS.findall(text)))
        return self.encode(text)

    def of(self, text: str) -> bytes:
        if not self.by_pieces:
            return self.encode(text)
        first, *rest = text.split(" ")
        if first and first[-1].isspace():
            return self.slow(text)
        try:
            return self.cut(first) + b"".join(map(self.__getitem__, rest))
        except LookupError:
            return self.slow(text)

    def slow(self, text: str) -> bytes:
        """For texts with runs of white space: cut at the safe spaces only."""
        first, *rest = _SAFE.split(text)
        return (self.encode(first) if first else b"") + b"".join(self[p] if p and not p[-1].isspace() else self.encode(" " + p) for p in rest)


_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _IDS:
        _IDS[path] = WordIds(path)
    return _IDS[path]


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` if asked): each document's ids and ``end``, and only
    those over ``size`` ids cut into pieces of ``size``, the first of which may be shorter. Null text: empty.
    ``carry``: more columns of ``docs`` to take along."""
    ready(docs.sparkSession)
    carry = carry or []
    src = free_name(docs, "src_text")
    rows = docs.select(F.col(doc_id).alias("doc_id"), *carry, F.coalesce(F.col(text), F.lit("")).alias(src))
    schema = rows.drop(src).schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tail = word_ids(tokenizer), np.array([end], "<u4").tobytes()
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                take, piece, start, length, crc, ids = [], [], [], [], [], []
                for r, t in enumerate(part.column(part.num_columns - 1)):
                    raw = encoder.of(t.as_py()) + tail
                    n = len(raw) // 4
                    cuts = [0, *range(n % size or size, n, size), n]
                    for k in range(len(cuts) - 1):
                        own = raw[4 * cuts[k] : 4 * cuts[k + 1]]
                        take.append(r)
                        piece.append(k)
                        start.append(cuts[k])
                        length.append(cuts[k + 1] - cuts[k])
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            ids.append(np.frombuffer(own, "<i4"))
                kept = part.take(pa.array(take, pa.int64()))
                out = [*kept.columns[:-1], pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return rows.mapInArrow(run, schema)


# ---- packing lengths: bins are patterns (how many items of each length), each with a number of like bins -------

Pattern = tuple[tuple[int, int], ...]  # ((length, items), ...), lengths falling
Solution = dict[Pattern, int]


def fill(pattern: Pattern) -> int:
    whole = 0
    for n, c in pattern:
        whole += n * c
    return whole


def best_fit(items: dict[int, int], bins: Solution, size: int, order: list[int] | None = None) -> Solution:
    """Add ``items`` (length: count) to ``bins``, each length in turn into the fullest bins that still take it."""
    room: list[Solution] = [{} for _ in range(size + 1)]
    for p, m in bins.items():
        at = room[size - fill(p)]
        at[p] = at.get(p, 0) + m
    some = sum(1 << r for r, at in enumerate(room) if at)  # bit r: bins with this much room may be left
    for n in order or sorted(items, reverse=True):
        left, r = items[n], n
        while left and (more := some >> r):
            r += (more & -more).bit_length() - 1
            if not room[r]:
                some ^= 1 << r
                continue
            p, m = room[r].popitem()
            each = min(left, r // n)
            whole = min(m, left // each)
            if whole < m:
                room[r][p] = m - whole
            new = dict(p)
            new[n] = new.get(n, 0) + each
            key = tuple(sorted(new.items(), reverse=True))
            at = room[r - each * n]
            at[key] = at.get(key, 0) + whole
            some |= 1 << r - each * n
            left -= whole * each
            # a bin that took fewer than it could is the fullest that still takes this length only if left is 0
        if left:
            each = size // n
            for c, m in ((each, left // each), (left % each, 1)):
                if c and m:
                    at, key = room[size - c * n], ((n, c),)
                    at[key] = at.get(key, 0) + m
                    some |= 1 << size - c * n
    out: Solution = {}
    for at in room:
        for p, m in at.items():
            out[p] = out.get(p, 0) + m
    return out


def bins_of(s: Solution) -> int:
    return sum(s.values())


def score(s: Solution, size: int) -> tuple[int, float]:
    """Fewer bins first, then the mean squared fill: of equal counts, the one with fuller full bins."""
    return -bins_of(s), sum(m * (fill(p) / size) ** 2 for p, m in s.items()) / max(1, bins_of(s))


def crossover(a: Solution, b: Solution, items: dict[int, int], size: int, rng: random.Random) -> Solution:
    """Inject whole well-filled bins of ``b``; drop the bins of ``a`` that hold items now twice; best-fit the
    displaced items."""
    full = [p for p in b if fill(p) >= 0.995 * size and rng.random() < 0.5]
    child: Solution = {p: rng.randint(1, b[p]) for p in full}
    left = dict(items)
    for p, m in child.items():
        for n, c in p:
            left[n] -= c * m
    for p in sorted(a, key=fill, reverse=True):
        m = min(a[p], *(left[n] // c for n, c in p))
        if m:
            child[p] = child.get(p, 0) + m
            for n, c in p:
                left[n] -= c * m
    return best_fit({n: c for n, c in left.items() if c}, child, size)


def mutate(s: Solution, size: int, rng: random.Random) -> Solution:
    """Open some of the emptier bins and a few others, and best-fit their items in an order shuffled a little or a lot."""
    out, freed = dict(s), {}
    ranked_bins = sorted(out, key=fill)
    for p in ranked_bins[: 1 + len(ranked_bins) // 20] + rng.sample(ranked_bins, min(len(ranked_bins), 3)):
        m = out.pop(p, 0)
        back = m if m <= 2 else rng.randint(1, m)
        if m - back:
            out[p] = m - back
        for n, c in p if back else ():
            freed[n] = freed.get(n, 0) + c * back
    noise = rng.choice((0.1, 0.3, 0.9))
    order = sorted(freed, key=lambda n: n * rng.uniform(1 - noise, 1 + noise), reverse=True)
    return best_fit(freed, out, size, order)


def to_row(s: Solution) -> list[int]:
    """One flat list: for every pattern its bins, its number of lengths, then length and items of each."""
    return [x for p, m in sorted(s.items(), reverse=True) for x in (m, len(p), *(y for pair in p for y in pair))]


def from_row(flat: list[int]) -> Solution:
    s: Solution = {}
    i = 0
    while i < len(flat):
        m, k = int(flat[i]), int(flat[i + 1])
        p = tuple((int(flat[j]), int(flat[j + 1])) for j in range(i + 2, i + 2 + 2 * k, 2))
        s[p] = s.get(p, 0) + m
        i += 2 + 2 * k
    return s


def evolve(population: list[Solution], items: dict[int, int], size: int, rng: random.Random, patience: int, keep_best: int) -> list[Solution]:
    """Crossovers until ``patience`` of them in a row have saved no bin, or the least possible number of bins is reached."""
    bound = -(-sum(n * c for n, c in items.items()) // size)
    best, idle = min(map(bins_of, population)), 0
    scored = sorted(((score(s, size), s) for s in population), key=itemgetter(0), reverse=True)
    while best > bound and idle < patience:
        a, b = (s for _, s in (rng.sample(scored[: max(2, len(scored) // 2)], 2) if len(scored) > 1 else scored * 2))
        child = crossover(a, b, items, size, rng)
        child = mutate(child, size, rng) if rng.random() < 0.5 else child
        scored = sorted([*scored, (score(child, size), child)], key=itemgetter(0), reverse=True)[:keep_best]
        idle = idle + 1 if -scored[0][0][0] == best else 0
        best = -scored[0][0][0]
    return [s for _, s in scored]


def pack_lengths(spark, items: dict[int, int], size: int, islands: int = 4, members: int = 4, patience: int = 40, seed: int = 1) -> Solution:
    """Bins for ``items`` (length: count, lengths up to ``size``), as few as the islands find.

    What evolves is the histogram of lengths, at most ``size`` numbers however many documents there are; like
    bins are one pattern with a count. Every island is one Spark task; after each epoch its best member also moves
    to the next island. Nothing evolves once best fit reaches the least possible number of bins. The rule for the effort is the
    same at every size: an island goes on until ``patience`` crossovers in a row have saved no bin, and epochs go on until one
    has saved none on any island (two at least, so that each island meets a neighbour's best).
    """
    if not items:
        return {}
    first = best_fit(items, {}, size)
    bound = -(-sum(n * c for n, c in items.items()) // size)
    if bins_of(first) <= bound:
        return first
    lengths = sorted(items.items())

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        island = int(pdf.island.iloc[0])
        rng = random.Random(seed * 1000 + island)
        own = [best_fit(dict(lengths), {}, size, sorted(dict(lengths), key=lambda n: n * (1 if k == 0 else rng.uniform(0.9, 1.1)), reverse=True)) for k in range(members)]
        return pd.DataFrame({"island": island, "epoch": 0, "bins": [bins_of(s) for s in own], "flat": [to_row(s) for s in own]})

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        island, epoch = int(pdf.island.iloc[0]), int(pdf.epoch.iloc[0])
        rng = random.Random(seed * 1000 + island + 100 * (epoch + 1))
        own = evolve([from_row(f) for f in sorted(map(list, pdf.flat))], dict(lengths), size, rng, patience, members)
        out = pd.DataFrame({"island": island, "epoch": epoch + 1, "bins": [bins_of(s) for s in own], "flat": [to_row(s) for s in own]})
        elite = out.head(1).assign(island=(island + 1) % islands)
        return pd.concat([out, elite], ignore_index=True)

    schema = "island int, epoch int, bins long, flat array<long>"
    pop = spark.range(islands).select(F.col("id").cast("int").alias("island")).groupBy("island").applyInPandas(start, schema)
    best, epoch = bins_of(first), 0
    while True:
        new = keep(pop.repartition(islands, "island").groupBy("island").applyInPandas(step, schema))
        if epoch:
            forget(pop)
        pop, epoch = new, epoch + 1
        fewest = pop.agg(F.min("bins")).first()[0]
        if fewest <= bound or (epoch > 1 and fewest >= best):
            break
        best = min(best, fewest)
    held = max((from_row(r.flat) for r in pop.filter(F.col("bins") == fewest).toLocalIterator()), key=lambda s: score(s, size))
    forget(pop)
    return max(held, first, key=lambda s: score(s, size))


def layout(solution: Solution, size: int) -> tuple[np.ndarray, ...]:
    """Slots in order of (length, place): ``length, first place, bins' first number, items a bin, offset in it``."""
    slots, seq = [], 0
    for p, m in sorted(solution.items(), reverse=True):
        at = 0
        for n, c in p:
            slots.append((n, m * c, seq, c, at))
            at += n * c
        seq += m
    slots.sort()
    a = np.array(slots, np.int64).reshape(-1, 5)
    first = np.concatenate([[0], np.cumsum(a[:, 1])[:-1]]) if len(a) else np.zeros(0, np.int64)
    return a[:, 0], first, a[:, 2], a[:, 3], a[:, 4]


def pack_pieces(pieces: DataFrame, size: int = 2048, length: str = "length", **how) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: a gapless packing into sequences of at most ``size``.

    Lengths are 1 to ``size`` (others raise). Pieces of equal length are interchangeable, so only the histogram of
    lengths is packed (:func:`pack_lengths`); each piece finds its slot by its place among those of its length,
    counted in blocks, so a length that a third of the pieces share is no hot task. Repeated rows are separate
    pieces. Columns of the result's names are replaced. No rows: no rows.
    """
    spark = ready(pieces.sparkSession)
    pieces = pieces.select(*[c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")])
    rid, place = free_name(pieces, "rid"), free_name(pieces, "place")
    rows = tagged(pieces, rid)
    items = {int(r[0]): int(r[1]) for r in rows.groupBy(length).count().collect()}  # at most `size` rows
    if any(not 1 <= n <= size for n in items):
        raise ValueError(f"lengths must be 1 to {size}")
    lengths, first, seq, each, offset = layout(pack_lengths(spark, items, size, **how), size)
    ns = np.array(sorted(items), np.int64)
    before = np.concatenate([[0], np.cumsum([items[int(n)] for n in ns])[:-1]]) if len(ns) else ns
    numbered = ranked(rows, [length], rid, place).drop(rid)
    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    cols = [*pieces.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.column(b.schema.get_field_index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            k = b.column(b.schema.get_field_index(place)).to_numpy(zero_copy_only=False)
            slot = np.searchsorted(first, before[np.searchsorted(ns, n)] + k, "right") - 1
            k = before[np.searchsorted(ns, n)] + k - first[slot]
            out = [b.column(b.schema.get_field_index(c)) for c in cols]
            yield pa.RecordBatch.from_arrays([*out, pa.array(seq[slot] + k // each[slot]), pa.array(offset[slot] + k % each[slot] * n)], names=[*cols, "sequence_id", "offset"])

    return numbered.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document.

    Null or empty text: the single id ``end``. Null and repeated ids: rows like any other. Other columns are
    ignored; no rows: no rows. :func:`packed_ids` gives the ids themselves.
    """
    return pack_pieces(token_pieces(docs, tokenizer, size, end, doc_id, text), size, **how)


def packed_ids(docs: DataFrame, packed: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``sequence_id, ids``: the sequences of :func:`pack_documents`, for documents of unique ids."""
    own = token_pieces(docs, tokenizer, size, end, doc_id, text, with_ids=True).select("doc_id", "piece", "ids")
    rows = own.join(packed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `size` ids
    return rows.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
