"""Ranked lexical search: a join seeded by thresholds that terms alone guarantee, with exact scores for its candidates."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from curvespace.llm.common import join_spread, keep, ready

#: Items of one tile, and postings of one block of documents: what a task holds at once.
ITEMS, POSTINGS = 4096, 1 << 18
#: The items' terms, up to this number and these bytes, go to all tasks, and postings of other terms are left out at once.
MOST_TERMS, MOST_BYTES = 1 << 18, 1 << 24

#: Terms are runs of ASCII letters and digits and of all that is not ASCII; only A-Z are lower-cased.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def counted(rows: DataFrame, ident: str, text: str, wanted=None) -> DataFrame:
    """``id, n, terms, tf``: of each row the number of terms, and its different terms (of the broadcast set ``wanted``, if
    given) with their occurrences."""
    schema = StructType([StructField("id", rows.schema[ident].dataType), StructField("n", LongType()), StructField("terms", ArrayType(BinaryType())), StructField("tf", ArrayType(LongType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = wanted.value if wanted is not None else None
        for b in batches:
            n, ends, terms, tf = [], [0], [], []
            for t in b.column(1):
                words = (t.as_py() or b"").translate(_BYTES).split()
                own = Counter(words)
                n.append(len(words))
                found = own.keys() if only is None else own.keys() & only
                terms += found
                tf += map(own.__getitem__, found)
                ends.append(len(terms))
            at = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.binary())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))], names=schema.names)

    return rows.select(F.col(ident), F.col(text).cast("binary")).mapInArrow(count, schema)


def impact(tf: Column, n: Column, docs: int, terms: int) -> Column:
    """What an occurrence count adds for each unit of the term's weight, in whole numbers."""
    long = lambda v: F.lit(v).cast("long")
    m = long(75) + F.call_function("div", long(25 * docs) * n, long(max(1, terms)))
    return F.call_function("div", long(1_000_000_000) * tf, long(1000) * tf + long(12) * m)


class Block:
    """The postings of a block of documents by term, with what each adds for a unit of its term's weight."""

    def __init__(self, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: pa.Array, tf: np.ndarray, docs: int, total: int):
        self.ids = ids
        self.order = np.unique(ids, return_inverse=True)[1] if len(ids) else ids
        row = np.repeat(np.arange(len(ids)), sizes)
        m = 75 + 25 * docs * n // max(1, total)
        each = 1_000_000_000 * tf // (1000 * tf + 12 * m[row])
        coded = terms.dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        by = np.argsort(code, kind="stable")  # rows rise within a term
        self.row, self.each = row[by], each[by]
        self.at = {t: k for k, t in enumerate(coded.dictionary.to_pylist())}
        self.ends = np.searchsorted(code[by], np.arange(len(self.at) + 1))
        self.score = np.zeros(len(ids), np.int64)
        self.candidates = 0

    def postings(self, term: bytes) -> slice | None:
        k = self.at.get(term)
        return None if k is None else slice(int(self.ends[k]), int(self.ends[k + 1]))

    def search(self, terms: list[dict], floor: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and scores of the ``k`` best documents of the block for an item, as far as they reach ``floor``. Candidates hold at
        least one term that the floor does not rule out; each gets its whole score."""
        lists = [(t, s) for t in terms if (s := self.postings(t["term"])) is not None]
        lead = [self.row[s] for t, s in lists if t["lead"]]
        if not lead:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        rows = np.unique(np.concatenate(lead))
        self.candidates += len(rows)
        got = np.zeros(len(rows), np.int64)
        for t, s in lists:
            own, each = self.row[s], self.each[s]
            if 8 * len(rows) < len(own):  # few candidates: look them up in the term's list
                at = np.minimum(np.searchsorted(own, rows), len(own) - 1)
                hit = own[at] == rows
                got[hit] += t["q"] * t["w"] * each[at[hit]]
            else:
                self.score[own] = t["q"] * t["w"] * each
                got += self.score[rows]
                self.score[own] = 0
        good = got >= floor
        rows, got = rows[good], got[good]
        best = np.lexsort((self.order[rows], -got))[:k]
        return rows[best], got[best]


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: for each item the ``k`` documents of highest score above 0 (all, if fewer), ties to
    the smaller id.

    With N documents that hold a term, L terms in all, df documents with a term: its weight is w = floor(1000 ln((2N + 2) / (2df + 1))); a
    document of n terms, tf of them this one, adds w * (10**9 tf div (1000 tf + 12 m)) for each time the item has it, with m = 75 + 25nN div L;
    whole numbers of 64 bits. Null and empty texts have no terms. Documents of null id count in N, L and df but are not
    ranked; rows of one id are ranked apart. Repeated rows of an item count once; different texts of one item id are taken
    together; items of null id take no part. Other columns are ignored. No rows on either side: no rows.

    For every term the greatest and the ``k``-th greatest addition are stored. The ``k``-th one is a floor for the score of each
    item's ``k``-th document. An item's terms are put in order of the most that they can add; the last ones, which all together
    stay below the floor, lead to no candidates (:class:`Block`). Documents that hold another one are scored in
    full. Documents meet items by blocks of ``POSTINGS`` postings and tiles of ``ITEMS`` items.
    """
    spark = ready(docs.sparkSession)
    texts = items.filter(F.col(item_id).isNotNull()).select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).distinct()
    own = keep(counted(texts, "id", "text").select(F.col("id").alias("item"), F.explode(F.arrays_zip("terms", "tf")).alias("t")).groupBy("item", F.col("t.terms").alias("term")).agg(F.sum("t.tf").alias("q")))
    asked = keep(own.select("term").distinct())
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("term")), F.lit(0)).alias("b")).first()
    few = size.n <= MOST_TERMS and size.b <= MOST_BYTES
    wanted = spark.sparkContext.broadcast(frozenset(bytes(r.term) for r in asked.collect())) if few else None

    rows = keep(counted(docs, doc_id, text, wanted).withColumn("rid", F.monotonically_increasing_id()))
    total = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"), F.coalesce(F.sum(F.size("terms")), F.lit(0)).alias("postings")).first()
    each = rows.select("n", F.col("id").isNotNull().alias("known"), F.explode(F.arrays_zip("terms", "tf")).alias("t")).select("n", "known", F.col("t.terms").alias("term"), F.col("t.tf").alias("tf"))
    each = each if few else keep(each.join(asked, "term", "left_semi"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * total.docs + 2) / (2.0 * F.col("n") + 1))).cast("long")
    held = keep(each.groupBy("term").agg(F.count(F.lit(1)).alias("n")).withColumn("w", weight))
    adds = each.filter("known").withColumn("add", impact(F.col("tf"), F.col("n"), total.docs, total.terms)).select("term", "add")
    best = adds.withColumn("o", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("add")))).filter(F.col("o") <= k)
    ends = best.groupBy("term").agg(F.max("add").alias("top"), F.max(F.when(F.col("o") == k, F.col("add"))).alias("kth"))
    known = keep(held.join(ends, "term").select("term", "w", "top", "kth"))

    asks = own.withColumnRenamed("q", "q_")
    asks = asks.join(known, "term") if few else join_spread(asks, known.join(own.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term"), "term")
    most = F.col("q_") * F.col("w") * F.col("top")
    seeded = asks.withColumn("most", most).withColumn("floor", F.greatest(F.lit(1), F.coalesce(F.max(F.col("q_") * F.col("w") * F.col("kth")).over(Window.partitionBy("item")), F.lit(1))))
    rest = F.sum("most").over(Window.partitionBy("item").orderBy(F.desc("most"), "term").rowsBetween(0, Window.unboundedFollowing))
    term = F.struct("term", F.col("q_").alias("q"), "w", (F.col("rest") >= F.col("floor")).alias("lead"))
    plan = keep(seeded.withColumn("rest", rest).groupBy("item").agg(F.max("floor").alias("floor"), F.collect_list(term).alias("asks")))

    tiles, blocks = -(-plan.count() // ITEMS) or 1, -(-total.postings // POSTINGS) or 1
    dealt = lambda df, key, n, to, other, m: df.withColumn(to, F.pmod(F.xxhash64(key), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
    left = dealt(rows.filter((F.size("terms") > 0) & F.col("id").isNotNull()), "rid", blocks, "block", "tile", tiles).drop("rid")
    right = dealt(plan, "item", tiles, "tile", "block", blocks)
    schema = StructType([StructField("item_id", items.schema[item_id].dataType), StructField("doc_id", docs.schema[doc_id].dataType), StructField("score", LongType())])

    def met(documents: pa.Table, asks: pa.Table) -> pa.Table:
        out = {c: [] for c in schema.names}
        if documents.num_rows and asks.num_rows:
            lists = documents.column("terms").combine_chunks()
            block = Block(
                documents.column("id").to_numpy(), documents.column("n").to_numpy(), np.diff(lists.offsets.to_numpy()), lists.flatten(),
                documents.column("tf").combine_chunks().flatten().to_numpy(zero_copy_only=False), total.docs, total.terms,
            )
            for item, floor, terms in zip(asks.column("item"), asks.column("floor"), asks.column("asks"), strict=True):
                at, score = block.search(terms.as_py(), floor.as_py(), k)
                out["item_id"] += [item.as_py()] * len(at)
                out["doc_id"] += block.ids[at].tolist()
                out["score"] += score.tolist()
        kinds = (asks.schema.field("item").type, documents.schema.field("id").type, pa.int64())
        return pa.table({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds, strict=True)})

    found = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(met, schema)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def oracle(k: int = 20) -> str:
    """DuckDB SQL for the registered query, over documents and items of unique ids."""
    cut = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term"
    return f"""
WITH d AS (SELECT doc_id, {cut} FROM documents), i AS (SELECT item_id, {cut} FROM benchmark),
s AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS terms FROM d),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
q AS (SELECT item_id, term, count(*) AS q FROM i GROUP BY item_id, term),
r AS (SELECT item_id, doc_id, CAST(sum(q * w * (1000000000 * tf // (1000 * tf + 12 * (75 + 25 * n * docs // terms)))) AS BIGINT) AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), s GROUP BY item_id, doc_id)
SELECT item_id, rank, doc_id, score FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM r WHERE score > 0) WHERE rank <= {k}"""
