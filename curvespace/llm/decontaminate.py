"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification."""

from __future__ import annotations

import functools
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from curvespace.llm.common import free_name, keep, ready
from curvespace.llm.simhash import shingle_hashes, words_of
from curvespace.llm.warc import file_system

#: Benchmark items go to the tasks in slices of about this many bytes of text, through files in the shared folder; more
#: slices, more passes.
SLICE_BYTES = 32 << 20

LEAK = StructType([StructField("item_id", LongType()), StructField("similarity", DoubleType()), StructField("start", IntegerType()), StructField("n_words", IntegerType()), StructField("distance", IntegerType())])


class MultiIndex:
    """Fingerprints of one window size under ``radius + 1`` blocks of bits: two fingerprints within the radius agree
    in at least one block, so looking every block up finds all of them."""

    def __init__(self, fps: np.ndarray, radius: int):
        self.fps, self.radius = fps, radius
        edges = [64 * k // (radius + 1) for k in range(radius + 2)]
        self.blocks = [(np.uint64(lo), np.uint64((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]
        self.tables = []
        for lo, mask in self.blocks:
            table = defaultdict(list)
            for k, v in enumerate((fps >> lo) & mask):
                table[int(v)].append(k)
            self.tables.append({v: np.array(ks) for v, ks in table.items()})

    def near(self, fps: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``item, windows, distances`` for the windows of ``fps`` within the radius of each item."""
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for (lo, mask), table in zip(self.blocks, self.tables, strict=True):
            values = (fps >> lo) & mask
            for v in np.unique(values):
                if (items := table.get(int(v))) is not None:
                    at = np.flatnonzero(values == v)
                    for k in items:
                        found[int(k)].append(at)
        for k, at in found.items():
            at = np.unique(np.concatenate(at))
            far = np.bitwise_count(fps[at] ^ self.fps[k])
            ok = far <= self.radius
            if ok.any():
                yield k, at[ok], far[ok]


def window_fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every run of ``size`` shingles, repeats included: a bit is set if it is in over half of them."""
    bits = np.unpackbits(hashes.byteswap().view(np.uint8).reshape(-1, 8), axis=1)
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits((sums[size:] - sums[:-size]) * 2 > size, axis=1).view(">u8").ravel().astype(np.uint64)


class Benchmark:
    """Items prepared for the search in one task."""

    def __init__(self, items: list[tuple[int, str]], words: int, radius: int, similarity: float):
        self.words, self.similarity = words, similarity
        self.vocabulary: dict[bytes, int] = {}
        self.short: dict[tuple[int, ...], list[int]] = defaultdict(list)  # items of fewer words than a shingle
        by_size: dict[int, list] = defaultdict(list)
        shingles: dict[int, set[int]] = defaultdict(set)  # the sizes of the items that hold a shingle
        for item, text in items:
            own = words_of(text)
            if not own:
                continue
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in own)
            if len(own) < words:
                self.short[ids].append(item)
                continue
            h = shingle_hashes(own, words)
            by_size[len(h)].append((item, h, Counter(h.tolist())))
            for c in self.code(np.array(ids)).tolist():
                shingles[c].add(len(h))
        self.shingles = np.array(sorted(shingles), np.uint64)
        self.shingle_sizes = [sorted(shingles[c]) for c in sorted(shingles)]
        self.sizes = {n: ([g[0] for g in got], [g[2] for g in got], MultiIndex(np.concatenate([window_fingerprints(g[1], n) for g in got]), radius)) for n, got in by_size.items()}

    def code(self, ids: np.ndarray) -> np.ndarray:
        """One number for every run of ``words`` word numbers."""
        n = len(ids) - self.words + 1
        out = np.zeros(n, np.uint64)
        for k in range(self.words):
            out = out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64)
        return out

    def search(self, text: str | None) -> list[dict]:
        """The items a text leaks, each at its most similar window."""
        own = words_of(text)
        if not own:
            return []
        ids = np.fromiter(map(self.vocabulary.get, own, [0] * len(own)), np.int64, len(own))
        best: dict[int, tuple] = {}
        if self.short:
            listed = ids.tolist()
            for run, items in self.short.items():
                if len(own) >= len(run) and (at := next((i for i in range(len(own) - len(run) + 1) if listed[i] == run[0] and tuple(listed[i : i + len(run)]) == run), None)) is not None:
                    best |= {item: (1.0, -at, len(run), 0) for item in items}
        if len(own) >= self.words and len(self.shingles):
            # A window as similar as asked shares shingles with its item, so only windows near a shared one can be.
            runs = np.concatenate([[0], np.cumsum(ids > 0)])
            known = np.flatnonzero(runs[self.words :] - runs[: -self.words] == self.words)
            if len(known):
                codes = self.code(ids)[known]
                at = np.minimum(np.searchsorted(self.shingles, codes), len(self.shingles) - 1)
                hits: dict[int, list[int]] = defaultdict(list)
                for k in np.flatnonzero(self.shingles[at] == codes):
                    for n in self.shingle_sizes[at[k]]:
                        hits[n].append(known[k])
                for n, where in hits.items():
                    self.windows(own, n, np.array(where), best)
        return [{"item_id": k, "similarity": round(v[0], 9), "start": -v[1], "n_words": v[2], "distance": v[3]} for k, v in sorted(best.items())]

    def windows(self, own: list[bytes], n: int, hits: np.ndarray, best: dict[int, tuple]) -> None:
        """Windows of ``n`` shingles around the shingles ``hits`` shared with items of that size."""
        items, wanted, index = self.sizes[n]
        last = len(own) - self.words  # number of the last shingle
        breaks = np.flatnonzero(np.diff(hits) > n)
        for a, b in zip(np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(hits) - 1]]), strict=True):
            first, hi = max(0, int(hits[a]) - n + 1), min(last, int(hits[b]) + n - 1)
            for lo in range(first, hi + 1, 50_000):  # very long runs in pieces that overlap by a window
                h = shingle_hashes(own[lo : min(hi, lo + 50_000 + n - 1) + self.words], self.words)
                m = min(n, len(h))
                for k, at, far in index.near(window_fingerprints(h, m)):
                    for w, d in zip(at, far, strict=True):
                        have, want = Counter(h[w : w + m].tolist()), wanted[k]
                        both = sum(min(c, want.get(x, 0)) for x, c in have.items())
                        sim = both / (n + m - both)
                        if sim >= self.similarity and (new := (sim, -(lo + int(w)), m + self.words - 1, int(d))) > best.get(items[k], (0.0, 0, 0, 0)):
                            best[items[k]] = new


def with_leaks(docs: DataFrame, benchmark: DataFrame, into: str, words: int = 5, radius: int = 20, similarity: float = 0.8, text: str = "text", item_id: str = "item_id", item_text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` (all columns if not given) and ``into``: an array of ``item_id, similarity, start, n_words, distance``,
    one for each benchmark item that some window of the text matches, at its most similar window (ties: the first).

    A window has as many words as the item. Its SimHash over shingles of ``words`` words lies within ``radius`` bits
    of the item's, and the multisets of shingles have a Jaccard similarity of at least ``similarity``. A text
    shorter than an item is one window. Items of fewer than ``words`` words must occur as they are; items of no
    word or null text match nothing. Items of equal id count as different items and show once, at their best. Null
    text or no benchmark rows: an empty array.
    """
    ready(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    src = free_name(docs, "src_text", into)
    items = benchmark.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("body")).dropna()
    slices = int(items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0)) / SLICE_BYTES).first()[0]) + 1
    rows = docs.select(*carry, F.col(text).alias(src))
    found = []
    for k in range(slices):
        own = keep(items.filter(F.pmod(F.xxhash64("body"), F.lit(slices)) == k).coalesce(1))  # about SLICE_BYTES
        files, name = own.inputFiles(), into if slices == 1 else free_name(rows, f"leaks_{k}", into)
        found.append(name)

        def run(batches: Iterator[pa.RecordBatch], files=files, name=name) -> Iterator[pa.RecordBatch]:
            bench = prepared(tuple(files), words, radius, similarity)
            for b in batches:
                at = b.schema.get_field_index(src)
                leaks = pa.array([bench.search(t.as_py()) for t in b.column(at)], LEAKS)
                yield pa.RecordBatch.from_arrays([*b.columns, leaks], names=[*b.schema.names, name])

        rows = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(name, ArrayType(LEAK))]))
    if slices > 1:
        rows = rows.withColumn(into, F.concat(*found))
    return rows.select(*carry, into)


@functools.lru_cache(1)
def prepared(files: tuple[str, ...], words: int, radius: int, similarity: float) -> Benchmark:
    """The items in files of the shared folder, prepared once for a worker, not once for each task."""
    items = []
    for file in files:
        folder, _, name = file.rpartition("/")
        fs, root = file_system(folder)
        items += pq.read_table(f"{root}/{name}", filesystem=fs).to_pylist()
    return Benchmark(sorted((r["item"], r["body"]) for r in items), words, radius, similarity)


LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start", pa.int32()), ("n_words", pa.int32()), ("distance", pa.int32())]))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """``doc_id, item_id, similarity, start, n_words, distance``: see :func:`with_leaks`; clean documents have no row."""
    found = with_leaks(docs, benchmark, "leaks" if doc_id != "leaks" else "leaks_1", carry=[doc_id], **how)
    return found.select(F.col(doc_id).alias("doc_id"), F.inline(found.columns[-1]))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents in which a benchmark item shows; columns stay as they are."""
    name = free_name(docs, "leaks")
    return with_leaks(docs, benchmark, name, **how).filter(F.size(name) == 0).select(*docs.columns)
