"""SimHash near-duplicates: fingerprints, an exact Hamming self-join by segment popcounts, and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvespace.llm.common import components, free_name, keep, ready, tagged

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int32)
_MAX = 1 << 16


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z lowered: runs of bytes other than space and 0x09-0x0D."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def majority(hashes: np.ndarray) -> int:
    """64-bit number whose bits are set in over half of ``hashes`` (uint64); 0 for none."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, n, _MAX):
        lanes = hashes[at : at + _MAX].view(np.uint8).reshape(-1, 8)
        for j in range(8):
            counts[j] += np.bincount(lanes[:, 7 - j], minlength=256) @ _BITS
    return int.from_bytes(np.packbits(counts.ravel() * 2 > n).tobytes(), "big")


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``k`` words, space-joined, repeats included; of all words if fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(words[i:] for i in range(k)), strict=False) if len(words) > k else [words]
    return np.array([h(join(r), 42) for r in runs], np.uint64)


def fingerprint(text: str | None, k: int = 3) -> int:
    """SimHash of a text as an unsigned 64-bit number; 0 when it has no word."""
    return majority(shingle_hashes(words_of(text), k))


def with_fingerprint(docs: DataFrame, words: int, name: str, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (all if not given) and ``name``: the fingerprint as a signed long."""
    ready(docs.sparkSession)
    carry = docs.columns if carry is None else carry
    src = free_name(docs, "src_text")
    rows = docs.select(*carry, F.col(text).alias(src))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words) for t in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*b.schema.names[:-1], name])

    schema = rows.select(*carry).schema.add(name, "long")
    return rows.mapInArrow(run, schema)


def segment_cell(fp: Column, segments: int = 16) -> tuple[Column, list[Column]]:
    """The point of a fingerprint in segment-popcount space: bits set in each of ``segments`` equal segments,
    packed into one long, and the counts themselves."""
    width = 64 // segments
    step = width.bit_length()
    counts = [F.bit_count(F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1).cast("long"))).cast("long") for i in range(segments)]
    cell = counts[0]
    for i in range(1, segments):
        cell = cell + F.shiftleft(counts[i], step * i)
    return cell, counts


def hamming_links(fps: DataFrame, radius: int = 2, segments: int = 16) -> DataFrame:
    """Pairs ``(u, v)``, u < v, of the distinct fingerprints ``fps(fp)`` at ``radius`` (at most 2) or fewer bits.

    A bit flips one segment's count by one, so the Manhattan distance of two count vectors never exceeds the
    Hamming distance. Vectors at distance 2 or less share a lattice point at most one step from each: every
    fingerprint goes to its own cell and the cells one step away, cells are joined by equality, and the exact
    distance decides. Nothing within the radius is lost and no cell is capped. The cells are sorted: Spark sizes them by
    the rows before the explode, and would send up to 33 times its limit for a broadcast through the driver.
    """
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    width = 64 // segments
    step = width.bit_length()
    cell, counts = segment_cell(F.col("fp"), segments)
    steps = [F.lit(0).cast("long")]
    for i in range(segments):
        one = F.lit(1 << (step * i)).cast("long")
        steps += [F.when(counts[i] < width, one), F.when(counts[i] > 0, -one)]
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # one row becomes many
    near = spread.select("fp", cell.alias("own"), F.explode(F.array(*steps)).alias("d")).filter(F.col("d").isNotNull())
    near = near.select("fp", (F.col("own") + F.col("d")).alias("cell"))
    a, b = near.select(F.col("fp").alias("u"), "cell"), near.select(F.col("fp").alias("v"), "cell")
    close = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)
    return a.join(b.hint("merge"), "cell").filter(close).select("u", "v").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id``: documents whose fingerprints link, directly or through others.

    ``component_id`` is the least ``doc_id`` reachable. Equal texts share a fingerprint and so a component; they
    are grouped before the join. Null or blank text: fingerprint 0, linked like any other. Null ``doc_id``: the
    row takes part, its id never names a component unless no other does. Repeated rows come back as often as they
    went in. No input rows: no rows. Other columns are ignored.
    """
    fp = keep(with_fingerprint(docs, words, "fp", text, [doc_id]).select(F.col(doc_id).alias("doc_id"), "fp"))
    least = keep(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = keep(hamming_links(least.select("fp"), radius))
    parts = components(links)
    named = parts.join(least, parts.node == least.fp).groupBy("root").agg(F.min("least").alias("cid"))
    cid = keep(parts.join(named, "root").select(F.col("node").alias("fp"), "cid"))
    all_ids = keep(least.join(cid, "fp", "left").select("fp", F.coalesce("cid", "least").alias("component_id")))
    return fp.join(all_ids, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of every component of :func:`near_duplicates`: the one of the least id, and of repeated
    rows any one. Columns stay as they are; rows with null id go by the same rule, ids first."""
    rid, fpn = free_name(docs, "rid"), free_name(docs, "fp")
    rows = tagged(docs, rid)
    fp = keep(with_fingerprint(rows, words, fpn, text, [rid, doc_id]).select(rid, F.col(doc_id).alias("id"), F.col(fpn).alias("fp")))
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col(rid))
    best = keep(fp.groupBy("fp").agg(F.min(order).alias("best")))
    parts = components(keep(hamming_links(best.select("fp"), radius)))
    rooted = best.join(parts, best.fp == parts.node, "left").select(F.coalesce("root", "fp").alias("root"), "best")
    stays = free_name(rows, "stays")
    stay = rooted.groupBy("root").agg(F.min("best").alias("best")).select(F.col(f"best.{rid}").alias(stays))
    return rows.join(stay, F.col(rid) == F.col(stays), "left_semi").select(*docs.columns)
