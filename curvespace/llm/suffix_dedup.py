"""Repeated substrings over all documents by sparse prefix doubling."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from curvespace.llm.common import forget, keep, ready
from curvespace.operators.cover import merge_ranges

_STEP = 0x9E3779B97F4A7C15
_BYTE = (np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_POWERS: dict[bool, np.ndarray] = {}

#: Documents are read in pieces of this many bytes, and what a piece gives is handed on before the next one is read.
CHUNK = 1 << 17
#: Runs of sampled positions that a task holds before it hands them on.
ROWS = 1 << 13
#: Positions of one rank that are compared in one group; larger groups are ranked at more lengths first.
GROUP = 200
#: Pairs of positions that are compared at a time.
PAIRS = 1 << 13


def _powers(n: int, inverse: bool) -> np.ndarray:
    """``_STEP`` (or its inverse modulo 2**64) to the powers 0 to n - 1."""
    have = _POWERS.get(inverse)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 12), pow(_STEP, -1, 1 << 64) if inverse else _STEP, np.uint64)
        have[0] = 1
        have = _POWERS[inverse] = np.multiply.accumulate(have)
    return have[:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def prefix_sums(data: bytes | np.ndarray) -> np.ndarray:
    """Polynomial prefix sums; :func:`names` turns them into the names of substrings."""
    b = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _powers(len(b), False), out=sums[1:])
    return sums


def names(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit names of the substrings [lo, hi): equal for equal bytes. Different bytes may share a name, so names only
    choose and group; bytes, or their :func:`digest`, decide."""
    return _mix((sums[hi] - sums[lo]) * _powers(len(sums), True)[lo] + (hi - lo).astype(np.uint64))


def digest(data: bytes) -> bytes:
    """128 bits of BLAKE2b, which stand for the bytes: nobody can build two strings that share them."""
    return hashlib.blake2b(data, digest_size=16).digest()


def _slide(x: np.ndarray, w: int, of=np.minimum) -> np.ndarray:
    """``of`` over every run of ``w`` values."""
    s = 1
    while s * 2 <= w:
        x = of(x[:-s], x[s:])
        s *= 2
    return of(x[: len(x) - (w - s)], x[w - s :]) if s < w else x


def _order(b: np.ndarray, half: int) -> np.ndarray:
    """For every position with ``half`` bytes before the end of ``b``: an odd 32-bit number that 16 of these bytes at most decide."""
    n = len(b) - half + 1
    words = np.ndarray((len(b),), "<u8", np.concatenate([b, np.zeros(8, np.uint8)]), strides=(1,))
    x = words[:n] & np.uint64((1 << 8 * min(half, 8)) - 1)
    x *= np.uint64(_STEP)
    x ^= x >> np.uint64(32)
    if half > 8:
        at = min(half - 8, 8)
        x += words[at : at + n]
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def anchors(data: bytes, size: int, hulls: bool = True, ends: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """``first, last, times, rank, hull`` of positions sampled by content, piece by piece of ``CHUNK`` bytes: runs of ``times``
    sampled positions, one after the other, of one rank at length size / 2 and one hull, whose digest is given if asked for.

    A position is sampled if its number (:func:`_order`) is least among those whose half-length strings lie in some ``size`` bytes
    with its own, so every ``size`` bytes hold one, at the same place wherever these bytes occur. The hull of a position is the
    union of the ``size``-byte windows that hold its half-length string; where it is cut short by an end of the
    document, the digest tells how. Bytes that repeat in short periods make long runs, which are one row each.
    ``ends``: ``data`` is several documents that end there; no window and no run goes from one into the next.
    """
    half = size // 2
    w = size - half + 1
    n = len(data)
    ends = np.array([n]) if ends is None else ends
    starts = np.concatenate([[0], ends[:-1]])
    flat, places = np.frombuffer(data, np.uint8), [k.to_bytes(4) for k in range(w)]
    for lo in range(0, max(1, n - size + 1), CHUNK):
        left, right = max(0, lo - 2 * size), min(n, lo + CHUNK + 3 * size)
        h = _order(flat[left:right], half)
        low = np.zeros(len(h) + w - 1, np.uint32)  # by window, with those that begin before and after the piece
        low[w - 1 : len(h)] = _slide(h, w)
        for end in (ends[np.searchsorted(ends, left, "right") : np.searchsorted(ends, right + size)] - left + w - 1).tolist():
            low[max(0, end - size + 1) : end] = 0  # windows into the next document
        chosen = np.flatnonzero(h == _slide(low, w, np.maximum))
        chosen = chosen[(chosen + left >= lo) & (chosen + left < (lo + CHUNK if lo + CHUNK < n - size + 1 else n))]
        doc = np.searchsorted(ends, chosen + left, "right")
        rank, hull = names(prefix_sums(flat[left:right]), chosen, chosen + half), []
        new = np.ones(len(chosen), bool)
        new[1:] = (rank[1:] != rank[:-1]) | (doc[1:] != doc[:-1])
        chosen += left
        if hulls:
            a, b = np.maximum(chosen - (w - 1), starts[doc]), np.minimum(chosen + half + w - 1, ends[doc])
            hull = [digest(data[x:y] + places[c]) for c, x, y in zip((chosen - a).tolist(), a.tolist(), b.tolist(), strict=True)]
            for k in np.flatnonzero(~new).tolist():  # few, but in short periods
                new[k] = hull[k] != hull[k - 1]
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(chosen))[: len(first)]
        yield chosen[first], chosen[last - 1], last - first, rank[first], hull if new.all() else [hull[k] for k in first.tolist()] if hulls else []


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Documents (of one byte at least) side by side, ``CHUNK`` bytes or one document a time: ``number of the first, ends, bytes``."""
    held, at, many = [], 0, 0
    for k, data in enumerate(column):
        held.append(data.as_py())
        many += len(held[-1])
        if many >= CHUNK or k == len(column) - 1:
            yield at, np.cumsum([len(x) for x in held]), b"".join(held)
            held, at, many = [], k + 1, 0


def _row_key(docs: DataFrame) -> tuple[Column, Column]:
    """``id, t`` of ``docs(doc_id, text)``: a null-free long for the id, and a name of the text that tells rows of one
    id apart."""
    whole = isinstance(docs.schema["doc_id"].dataType, IntegralType)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))) if whole else F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull())
    return key.alias("id"), F.xxhash64(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("t")


def _sampled(src: DataFrame, size: int) -> DataFrame:
    """``id, t, pos, last, times, key, hull`` of every run of sampled positions."""
    names_ = ["id", "t", "pos", "last", "times", "key", "hull"]

    def out(held: list[tuple]) -> pa.RecordBatch:
        ids, t, pos, last, times, key = (np.concatenate([x[k] for x in held]) for k in range(6))
        hull = pa.array([h for x in held for h in x[6]], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(t), pa.array(pos.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(times), pa.array(key.view(np.int64)), hull], names=names_)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for b in batches:
            ids, t = (b.column(k).to_numpy() for k in (0, 1))
            for at, ends, data in _pieces(b.column(2)):
                starts = np.concatenate([[0], ends[:-1]])
                for first, last, *more in anchors(data, size, ends=ends):
                    doc = np.searchsorted(ends, first, "right")
                    held.append((ids[at + doc], t[at + doc], first - starts[doc], last - starts[doc], *more))
                    rows += len(first)
                    if rows >= ROWS:
                        yield out(held)
                        held, rows = [], 0
        if held:
            yield out(held)

    return src.mapInArrow(sample, "id long, t long, pos int, last int, times long, key long, hull binary")


def _ranks(src: DataFrame, size: int) -> DataFrame:
    """``key, times`` of every run of sampled positions."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        out = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[3] for x in held]).view(np.int64)), pa.array(np.concatenate([x[2] for x in held]))], names=["key", "times"])
        for b in batches:
            for _, ends, data in _pieces(b.column(0)):
                for got in anchors(data, size, False, ends):
                    held.append(got)
                    rows += len(got[0])
                    if rows >= ROWS:
                        yield out()
                        held, rows = [], 0
        if held:
            yield out()

    return src.select("bytes").mapInArrow(sample, "key long, times long")


def _settle(rows: DataFrame, ranks: DataFrame) -> DataFrame:
    """``rows(key, hull, id, t, pos, times, ...)`` without those whose ``key`` is unique in ``ranks(key, times)``; with ``settled``, whether
    the hull occurs again, ``first``, whether it is the first of its hull, and ``n``, the open rows and first ones of
    the key."""
    keys = keep(ranks.groupBy("key").agg(F.sum("times").alias("c")).filter("c > 1").select("key"))
    alive = keep(rows.join(keys, "key"))
    at = F.struct("id", "t", "pos")
    hulls = keep(alive.groupBy("hull").agg(F.sum("times").alias("c"), F.min(at).alias("lead")).filter("c > 1").drop("c"))
    told = keep(alive.join(hulls, "hull", "left").withColumn("settled", F.col("lead").isNotNull()).withColumn("first", F.coalesce(F.col("lead") == at, F.lit(False))).drop("lead"))
    open_ = keep(told.filter("not settled or first").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("not settled")).alias("o")).filter("o > 0").select("key", "n"))
    out = keep(told.join(open_, "key", "left"))
    forget(keys, alive, hulls, told, open_)
    return out


def repeated_spans(docs: DataFrame, size: int = 200, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, t, spans``: by document (see :func:`_row_key`), the spans of its bytes that ``size``-byte strings occurring
    elsewhere too cover. Spans may overlap.

    Sampled positions are ranked at half the length (:func:`anchors`) and the unique are dropped: no window over
    them repeats. A position whose hull repeats is settled: every window over it does. The others are ranked at the
    full length, each against the open positions of equal rank and one settled position of each hull.
    A rank that more than ``GROUP`` positions share is first ranked again at lengths halfway to the full one, for
    the earlier and the later half of its windows, until its groups are small, unique or settled.

    Ranks are 64-bit names, which only bring positions together. A hull repeats if its 128-bit digest does, and two
    windows are equal if their bytes are (:func:`shared_windows`).
    """
    ready(docs.sparkSession)
    half = size // 2
    w = size - half + 1
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    src = own.select(*_row_key(own), F.col("text").cast("binary").alias("bytes")).filter(F.length("bytes") >= size)
    ranked = _settle(_sampled(src, size), _ranks(src, size))
    span = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    pos = F.col("pos")
    done = [ranked.filter("settled").select("id", "t", span(F.greatest(pos - (w - 1), F.lit(0)), F.col("last") + (half + w - 1)).alias("s"))]

    # what a window takes before and after the half-length string, for the positions still to be compared
    at = ranked.filter("n is not null and (first or not settled)").groupBy("id", "t").agg(F.collect_list(F.struct("pos", "key", "n", "settled")).alias("at"))
    at = at.withColumnsRenamed({"id": "i", "t": "u"})
    near = src.join(at, (F.col("id") == F.col("i")) & (F.col("t") == F.col("u"))).select("id", "t", "bytes", F.explode("at").alias("p"))
    begin = f"greatest(p.pos - {w - 1}, 0)"
    rows = keep(near.select(
        "id", "t", "p.pos", "p.key", "p.n", F.col("p.settled").alias("rep"), F.lit(0).alias("a"), F.lit(w - 1).alias("b"),
        F.expr(f"substring(bytes, {begin} + 1, p.pos - {begin})").alias("before"), F.expr(f"substring(bytes, p.pos + 1, {half})").alias("core"), F.expr(f"substring(bytes, p.pos + {half} + 1, {w - 1})").alias("after"),
    ).dropDuplicates(["id", "t", "pos"]))
    small = []
    while True:
        small.append(rows.filter(F.col("n") <= GROUP))
        hot = rows.filter(F.col("n") > GROUP)
        if hot.isEmpty():
            break
        mid = F.expr("(a + b) div 2").cast("int")
        parts = hot.withColumn("h", F.explode(F.array(F.struct(F.col("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("b"))))).withColumn("a", F.col("h.a")).withColumn("b", F.col("h.b")).drop("h")
        least, most = F.greatest("a", F.lit(w - 1) - F.length("after")), F.least("b", F.length("before"))
        tail = lambda k: F.expr(f"substring(before, greatest(length(before) - {k}, 0) + 1, {k})")
        head = lambda k: F.expr(f"substring(after, 1, {w - 1} - {k})")
        shape = F.concat_ws(",", "a", "b", F.length(tail("b")), F.length(head("a"))).cast("binary")
        hull = F.unhex(F.substring(F.sha2(F.concat(shape, "core", tail("b"), head("a")), 256), 1, 32))
        parts = parts.filter(least <= most).withColumn("hull", hull).withColumn("key", F.xxhash64("key", "a", "b", tail("a"), head("b"))).drop("n").withColumn("times", F.lit(1).cast("long"))
        again = _settle(parts, parts)
        done.append(again.filter("settled and not rep").select("id", "t", span(pos - most, pos - least + size).alias("s")))
        rows = again.filter("n is not null and (first or not settled)").withColumn("rep", F.col("rep") | F.col("settled")).drop("hull", "settled", "first", "times")

    todo = small[0]
    for more in small[1:]:
        todo = todo.unionByName(more)
    buckets = max(1, todo.count() // 2000)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """The windows that occur twice among positions of one rank, as spans."""
        text = np.zeros((len(pdf), 2 * (w - 1) + half), np.uint8)  # half-length strings side by side, with what surrounds them
        for i, (x, c, y) in enumerate(zip(pdf.before, pdf.core, pdf.after, strict=True)):
            text[i, w - 1 - len(x) : w - 1 + half + len(y)] = np.frombuffer(bytes(x) + bytes(c) + bytes(y), np.uint8)
        before, after = (pdf[c].map(len).to_numpy(np.int64) for c in ("before", "after"))
        rep, a, b = (pdf[c].to_numpy() for c in ("rep", "a", "b"))
        row, least, most = shared_windows(text, pdf.key.to_numpy(), before, after, a, b, w - 1, half, ~rep)
        lo, hi = pdf.pos.to_numpy()[row] - most, pdf.pos.to_numpy()[row] - least + size
        return joined(pd.DataFrame({"id": pdf.id.to_numpy()[row], "t": pdf.t.to_numpy()[row], "lo": lo, "hi": hi}))

    exact = todo.withColumn("bucket", F.pmod("key", F.lit(buckets))).groupBy("bucket").applyInPandas(compare, "id long, t long, lo int, hi int")
    found = exact.select("id", "t", span(F.col("lo"), F.col("hi")).alias("s"))
    for more in done:
        found = found.unionByName(more)
    # spans that meet are joined in the order of a document, so that few are left to gather
    few = merge_ranges(found.select("id", "t", "s.lo", "s.hi"), ("id", "t"), 0)
    return few.groupBy("id", "t").agg(F.collect_list(span(F.col("lo"), F.col("hi"))).alias("spans"))


def pairs_of(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of rows of equal ``key``, once."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
    many = np.diff(np.append(first, len(order)))
    at = np.arange(len(order))
    follow = np.repeat(first + many, many) - at - 1  # rows of its key after each
    one = np.repeat(at, follow)
    two = np.arange(len(one)) - np.repeat(np.cumsum(follow) - follow, follow) + one + 1
    return order[one], order[two]


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By row, how many values at the start are equal."""
    differ = a != b
    at = differ.argmax(axis=1)
    return np.where(differ[np.arange(len(at)), at], at, a.shape[1])


def shared_windows(text: np.ndarray, key: np.ndarray, before: np.ndarray, after: np.ndarray, first: np.ndarray, last: np.ndarray, side: int, half: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``row, least, most``: the windows that a ``wanted`` line of ``text`` shares with another of its ``key``, one range for
    each such line.

    A line holds ``half`` bytes from ``side`` on, ``before`` bytes before and ``after`` behind them; its windows are
    ``half + side`` bytes long and begin ``first`` to ``last`` bytes before the half-length string. Two lines share what their equal bytes
    around that string allow, and nothing where it differs: bytes decide, keys only choose pairs."""
    back, ahead = np.ascontiguousarray(text[:, :side][:, ::-1]), np.ascontiguousarray(text[:, side:])
    one, two = pairs_of(key)
    use = wanted[one] | wanted[two]
    one, two = one[use], two[use]
    out = [(np.zeros(0, np.int64),) * 3]
    for k in range(0, len(one), PAIRS):
        i, j = one[k : k + PAIRS], two[k : k + PAIRS]
        right = alike(ahead[i], ahead[j]) - half
        i, j, right = i[right >= 0], j[right >= 0], right[right >= 0]
        least = np.maximum(side - np.minimum(right, np.minimum(after[i], after[j])), np.maximum(first[i], first[j]))
        most = np.minimum(np.minimum(alike(back[i], back[j]), np.minimum(before[i], before[j])), np.minimum(last[i], last[j]))
        for x in (i, j):
            ok = (least <= most) & wanted[x]
            out.append((x[ok], least[ok], most[ok]))
    return tuple(np.concatenate([x[k] for x in out]) for k in range(3))


def equal_windows(text: np.ndarray, row: np.ndarray, off: np.ndarray, marks: list[np.ndarray], before: int, size: int) -> np.ndarray:
    """Numbers of the windows whose bytes occur twice: window k is ``size`` bytes of line ``row[k]`` of ``text`` from
    ``before - off[k]``. Windows of equal offset and ``marks`` are compared, byte by byte, with the first of them; those
    that differ from it go on among themselves."""
    out = []
    left = np.lexsort((*marks, off))
    while len(left):
        new = np.ones(len(left), bool)
        new[1:] = np.any([m[left][1:] != m[left][:-1] for m in (off, *marks)], axis=0)
        group = np.cumsum(new) - 1
        model = left[np.flatnonzero(new)][group]
        same = np.ones(len(left), bool)
        for o in np.unique(off[left[~new]]):
            at = np.flatnonzero((off[left] == o) & ~new)
            lo = before - int(o)
            same[at] = (text[row[left[at]], lo : lo + size] == text[row[model[at]], lo : lo + size]).all(axis=1)
        many = np.bincount(group[same]) > 1
        out.append(left[same & many[group]])
        left = left[~same]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def joined(spans: pd.DataFrame) -> pd.DataFrame:
    """Overlapping or touching spans of a document as one."""
    s = spans.sort_values(["id", "t", "lo"], kind="stable", ignore_index=True)
    top = s.groupby(["id", "t"], sort=False).hi.cummax()
    new = s.id.ne(s.id.shift()) | s.t.ne(s.t.shift()) | (s.lo > top.shift())
    first = np.flatnonzero(new.to_numpy())
    last = np.append(first[1:], len(s))[: len(first)] - 1
    return pd.DataFrame({"id": s.id.to_numpy()[first], "t": s.t.to_numpy()[first], "lo": s.lo.to_numpy()[first].astype(np.int32), "hi": top.to_numpy()[last].astype(np.int32)})


def cut(data: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of ``data``, the bytes removed and the maximal runs they form."""
    if not spans:
        return data, 0, 0
    n = len(data)
    out, end, removed, runs = [], 0, 0, 0
    for lo, hi in sorted((s["lo"], min(s["hi"], n)) for s in spans):
        if hi <= end:
            continue
        if lo > end or not runs:
            out.append(data[end:lo])
            runs += 1
        start = max(lo, end)
        removed += hi - start
        end = hi
    out.append(data[end:])
    return b"".join(out), removed, runs


def remove_repeats(docs: DataFrame, size: int = 200, doc_id: str = "doc_id", text: str = "text", with_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and ``kept`` (bytes): documents without each byte that a
    ``size``-byte string covers which also starts anywhere else, in the same document or another.

    Null text: empty. Null and repeated ids: rows like any other (rows of one id with equal text count as two
    documents). Strings are judged on the input, so every copy goes. Other columns are ignored. No rows: no rows.
    """
    spans = keep(repeated_spans(docs, size, doc_id, text)).withColumnsRenamed({"id": "i", "t": "u"})
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = own.select("doc_id", *_row_key(own), F.coalesce("text", F.lit("")).cast("binary").alias("bytes"))
    rows = rows.join(spans, (F.col("id") == F.col("i")) & (F.col("t") == F.col("u")), "left").select("doc_id", "bytes", "spans")
    head = rows.select("doc_id").schema
    schema = head.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if with_bytes:
        schema = schema.add("kept", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(x, *cut(x, s)) for x, s in ((x.as_py(), s.as_py()) for x, s in zip(b.column(1), b.column(2), strict=True))]
            cols = [pa.array([len(g[0]) for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64()), pa.array([hashlib.sha256(g[1]).hexdigest() for g in got], pa.string())]
            if with_bytes:
                cols.append(pa.array([g[1] for g in got], pa.binary()))
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=schema.names)

    return rows.mapInArrow(run, schema)
