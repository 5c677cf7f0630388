"""Removal of repeated runs of lines, found as content-defined chunks; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curvespace.llm.common import forget, free_names, join_spread, keep

#: Modulus of the rolling hash over line hashes: a prime under 2**31, so products stay within a long.
PRIME = 2_147_483_647
BASE = 263

#: Rows of one repeated chunk that a task compares with its first occurrence.
COPIES = 20_000


def cut_chunks(docs: DataFrame, text: str, divisor: int, long: int, into: str) -> DataFrame:
    """``docs`` with ``into``: an array of the chunks of ``text``, each with ``cut``, ``k`` (first line), ``span`` (lines), ``hit``
    (its lines but for those that stand among blank ones) and ``key`` (128 bits of its lines' SHA-256).

    A boundary is the first line, and a line whose rolling hash with the next line is 0 modulo ``divisor``: it depends on
    nothing but these two lines, so what stands around a passage does not move the boundaries inside. A coarse chunk
    (``cut`` null) goes from a boundary to the line of the next one, that line included. The fine chunks are its pairs of
    neighbouring lines, ``cut`` being its first line, so each pair lies in one coarse chunk; two blank lines are no pair. A
    line of over ``long`` words is a chunk by itself (``cut`` -1). Null text: none.
    """
    lines, marks, cuts, coarse = free_names(docs, "lines_", "marks_", "cuts_", "coarse_")
    own = docs.columns

    def settle(df: DataFrame, name: str, value: Column, *keep_: str) -> DataFrame:
        """A computed column that later lambdas read as an attribute, not compute anew for each element."""
        return df.select(*own, *keep_, F.explode(F.array(value)).alias(name))

    words = lambda x: F.size(F.split(F.trim(F.regexp_replace(x, r"[ \t-\r]+", " ")), " "))
    # a line of n words has n - 1 separators at least, so most lines are not split
    is_long = lambda x: F.when(F.length(x) > 2 * long, words(x) > long).otherwise(F.lit(False))
    mark = lambda x: F.struct(F.unhex(F.substring(F.sha2(x.cast("binary"), 256), 1, 32)).alias("d"), is_long(x).alias("long"), x.rlike(r"[^ \t-\r]").alias("seen"))
    df = settle(docs, lines, F.split(F.col(text), "\n"))
    df = settle(df, marks, F.transform(lines, mark))
    m = F.col(marks)
    number = lambda i: F.conv(F.hex(F.substring(F.get(m, i)["d"], 1, 4)), 16, 10).cast("long")
    bounds = F.filter(F.sequence(F.lit(0), F.size(m) - 2), lambda i: (i == 0) | ((number(i) * BASE + number(i + 1)) % PRIME % divisor == 0))
    df = settle(df, cuts, F.when(F.size(m) > 1, bounds).otherwise(F.array().cast("array<int>")), marks)
    seen = lambda i: F.coalesce(F.get(m, i)["seen"], F.lit(False))
    key = lambda at, n: F.unhex(F.substring(F.sha2(F.aggregate(F.slice(m, at + 1, n), F.lit("").cast("binary"), lambda x, y: F.concat(x, y["d"])), 256), 1, 32))

    def chunk(at: Column, j: Column) -> Column:
        last = F.coalesce(F.get(F.col(cuts), j + 1), F.size(m) - 1)
        hit = F.filter(F.sequence(at, last), lambda i: seen(i) | ((i > at) & seen(i - 1)) | ((i < last) & seen(i + 1)))
        return F.struct(F.lit(None).cast("int").alias("cut"), at.alias("k"), (last - at + 1).alias("span"), hit.alias("hit"), key(at, last - at + 1).alias("key"))

    df = settle(df, coarse, F.transform(cuts, chunk), marks)
    pair = lambda c, i: F.struct(c["k"].alias("cut"), i.alias("k"), F.lit(2).alias("span"), F.array(i, i + 1).alias("hit"), key(i, F.lit(2)).alias("key"))
    pairs = F.flatten(F.transform(coarse, lambda c: F.transform(F.filter(F.sequence(c["k"], c["k"] + c["span"] - 2), lambda i: seen(i) | seen(i + 1)), lambda i: pair(c, i))))
    single = lambda x, i: F.when(x["long"], F.struct(F.lit(-1).alias("cut"), i.alias("k"), F.lit(1).alias("span"), F.array(i).alias("hit"), x["d"].alias("key")))
    singles = F.filter(F.transform(m, single), lambda c: c.isNotNull())
    return df.select(*own, F.concat(F.filter(coarse, lambda c: (c["span"] > 2) & (F.size(c["hit"]) > 0)), pairs, singles).alias(into))


def remove_repeated_chunks(docs: DataFrame, divisor: int = 8, long: int = 50, doc_id: str = "doc_id", text: str = "text", counts: str | None = None) -> DataFrame:
    """``docs`` with the lines of every chunk of :func:`cut_chunks` taken out of ``text`` whose bytes occur before: in a document of
    lesser id, or earlier in the same one. With ``counts``, a column of that name, in place of any there was, tells how many lines went.

    Coarse chunks settle long passages in few rows; fine chunks are held against each other only where their coarse chunk
    did not occur before. A pair in a coarse chunk that did occurs before, too, so nothing is lost by that: the lines of every
    repeated run of two or more lines go, blank lines among blank ones apart, whatever ``divisor`` is, and every repeated
    line of over ``long`` words. One occurrence stays: the first by (id with nulls last, text's hash, line).
    Candidates share a key of 128 bits; a chunk goes only if its bytes equal those of the first occurrence. A chunk
    of a third of all rows is dealt to many tasks, a copy of its bytes to each ``COPIES`` rows.
    Rows of equal id and text count as one and get equal results. Null text stays null, empty text empty; ids
    may be null or repeat. Other columns stay as they are. No rows: no rows.
    """
    ids, t, out, i, u, lines = free_names(docs, "ids", "sum", "gone", "gone_id", "gone_sum", "split")
    id_ = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"))
    rows = docs.withColumn(ids, id_).withColumn(t, F.xxhash64(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    named = (F.col(f"{ids}.none") == F.col(f"{i}.none")) & F.col(f"{ids}.id").eqNullSafe(F.col(f"{i}.id")) & (F.col(t) == F.col(u))
    found = cut_chunks(rows.select(F.col(ids).alias("id"), F.col(t).alias("t"), F.col(text).alias("text")), "text", divisor, long, "chunks")
    each = keep(found.select("id", "t", F.explode("chunks").alias("c")).select(F.struct("id", "t", "c.k").alias("at"), "c.cut", "c.span", "c.hit", "c.key"))

    def repeated(part: DataFrame) -> DataFrame:
        first = part.groupBy("key").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("n")).filter("first <> last")
        return keep(join_spread(part, keep(first.select("key", "first", "n", F.col("n").alias("copies"))), "key"))

    long_ones = repeated(each.filter("cut IS NULL"))
    settled = long_ones.filter("at <> first").select(F.col("at.id.none").alias("a"), F.col("at.id.id").alias("b"), F.col("at.t").alias("c"), F.col("at.k").alias("d")).distinct()
    inside = (F.col("at.id.none") == F.col("a")) & F.col("at.id.id").eqNullSafe(F.col("b")) & (F.col("at.t") == F.col("c")) & (F.col("cut") == F.col("d"))
    fine = keep(each.filter("cut IS NOT NULL").join(settled, inside, "left_anti"))
    met = long_ones.unionByName(repeated(fine))

    # the bytes of the chunks that met, from the texts; equal rows of documents give equal ones
    wanted = met.groupBy(F.col("at.id").alias(i), F.col("at.t").alias(u)).agg(F.collect_set(F.struct("at.k", "span", "hit", "key", "first", "copies")).alias("c"))
    texts = rows.select(ids, t, F.col(text).alias("text")).join(wanted.hint("merge"), named)
    texts = texts.select(F.struct(F.col(i).alias("id"), F.col(u).alias("t")).alias("doc"), F.explode(F.array(F.split("text", "\n"))).alias("lines"), "c")
    bodies = texts.select("doc", "lines", F.explode("c").alias("c")).select(
        F.struct("doc.id", "doc.t", "c.k").alias("at"), "c.hit", "c.key", "c.first", (1 + F.floor(F.col("c.copies") / COPIES)).cast("int").alias("parts"),
        F.array_join(F.slice("lines", F.col("c.k") + 1, F.col("c.span")), "\n").alias("body"),
    )
    bodies = keep(bodies)
    model = bodies.filter("at = first").groupBy("key", "parts").agg(F.min("body").alias("model")).select("key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "model")
    later = bodies.filter("at <> first").withColumn("part", F.pmod(F.xxhash64("at"), "parts").cast("int"))
    same = later.join(model.hint("merge"), ["key", "part"]).filter("body = model")
    lost = same.select("at.id", "at.t", F.explode("hit").alias("k"))
    gone = keep(lost.groupBy("id", "t").agg(F.collect_set("k").alias(out)).select(F.col("id").alias(i), F.col("t").alias(u), out))
    forget(each, fine, bodies)

    joined = rows.join(gone.hint("merge"), named, "left")
    split = joined.select(*joined.columns, F.explode(F.array(F.when(F.col(out).isNotNull(), F.split(F.col(text), "\n")))).alias(lines))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(out))
    new = F.when(F.col(out).isNull(), F.col(text)).otherwise(F.array_join(F.transform(stay, lambda k: F.get(F.col(lines), k)), "\n"))
    cols = [new.alias(c) if c == text else F.col(c) for c in docs.columns if c.lower() != (counts or "").lower()]
    return split.select(*cols, *([F.coalesce(F.size(out), F.lit(0)).alias(counts)] if counts else []))


def oracle(long: int = 50) -> str:
    """DuckDB SQL for ``doc_id, lines_removed, kept_md5`` over ``documents`` of unique, non-null ids: lines of pairs of neighbouring
    lines, not both blank, that occur before, and lines of over ``long`` words that do."""
    return f"""
WITH l AS (
  SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL)
), n AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS after, regexp_matches(line, '[^ \t-\r]') AS seen, len(regexp_extract_all(line, '[^ \t-\r]+')) > {long} AS wide FROM l
), p AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line, after ORDER BY doc_id, i) > 1 AS again FROM n WHERE after IS NOT NULL AND (seen OR regexp_matches(after, '[^ \t-\r]'))
), w AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) > 1 AS again FROM n WHERE wide
), g AS (
  SELECT doc_id, i FROM p WHERE again UNION SELECT doc_id, i + 1 FROM p WHERE again UNION SELECT doc_id, i FROM w WHERE again
), o AS (
  SELECT l.doc_id, count(g.i) AS lines_removed, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS body FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(coalesce(o.lines_removed, 0) AS INTEGER) AS lines_removed, CASE WHEN d.text IS NOT NULL THEN md5(o.body) END AS kept_md5
FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id"""
