import pathlib
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

SOURCES = pathlib.Path(__file__).resolve().parents[2] / "curvespace" / "llm"
#: Extra columns whose names the operators use for themselves: every alias and internal name in their sources.
CLASH = sorted({n.lower() for f in SOURCES.glob("*.py") for line in f.read_text().splitlines() if re.search(r"alias|withColumn|free_name|ranked|tagged", line) for n in re.findall(r'"([A-Za-z_]\w*)"', line)})


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents():
    rng = random.Random(7)
    base, item, lines = prose(rng, 120), prose(rng, 30), "\n".join(prose(rng, 8) for _ in range(12))
    near = base.split()
    near[60] = "changed"
    texts = [
        base, base, " ".join(near), base.upper(), None, "", "   \n\t ", "one", "two words", "a b c", item, f"{prose(rng, 40)} {item} {prose(rng, 40)}",
        " ".join([*item.split()[:29], "other"]), lines, f"{prose(rng, 5)}\n{lines}\n{prose(rng, 5)}", f"{lines}\n{lines}", prose(rng, 6000), "x" * 1000, "ab" * 500,
        "Gruße, naïve café 東京 はい 😀 don't  stop now <|endoftext|> 1234567 ...", "tiny item here", f"some tiny item here {prose(rng, 3)}", "\r\n\r\n", f"<html>{base}</html>",
    ]
    texts += [prose(rng, rng.randrange(1, 300)) for _ in range(40)]
    rows = [(10 * k, t) for k, t in enumerate(texts)]
    return [*rows, (None, base), rows[16], rows[13]], item


def write(folder, name, columns, clash=True):
    n = len(next(iter(columns.values())))
    extra = {c: pa.array(["clash"] * n, pa.string()) for c in CLASH if c not in columns} if clash else {}
    pq.write_table(pa.table(columns | extra), folder / f"{name}.parquet")


def tables(folder, docs, vectors, pages, items, labels, talks):
    col = lambda rows, k, kind: pa.array([r[k] for r in rows], kind)
    long, text = pa.int64(), pa.string()
    write(folder, "documents", {"doc_id": col(docs, 0, long), "text": col(docs, 1, text), "lang": pa.array(["en"] * len(docs), text), "source": pa.array([None] * len(docs), text), "n_chars": pa.array([len(d[1] or "") for d in docs], long)})
    write(folder, "embeddings", {"vec_id": col(vectors, 0, long), "embedding": col(vectors, 1, pa.list_(pa.float32())), "label": pa.array([0] * len(vectors), pa.int32())})
    write(folder, "pages", {"page_id": col(pages, 0, long), "url": col(pages, 1, text), "html": col(pages, 2, text)})
    write(folder, "benchmark", {"item_id": col(items, 0, long), "text": col(items, 1, text)})
    write(folder, "labels", {"doc_id": col(labels, 0, long), "quality": pa.array([1] * len(labels), pa.int32()), "toxic": col(labels, 1, pa.int32())})
    write(folder, "conversations", {"conv_id": col(talks, 0, long), "turn": col(talks, 1, long), "role": col(talks, 2, text), "text": col(talks, 3, text)})


@pytest.fixture(scope="session")
def case(tmp_path_factory):
    """``folder, tables``: small tables with nulls, ties, repeated rows, long texts and clashing columns."""
    folder, rng = tmp_path_factory.mktemp("case"), random.Random(3)
    docs, item = documents()
    vectors = [(k, [rng.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(6)]) for k in range(200)] + [(300, None), (320, [None] * 6), (340, [float("nan")] * 6), (360, [float("inf")] + [0.0] * 5), (None, [1.0] * 6)]
    vectors += vectors[:30]
    pages = [(k, f"http://h/{k}", rng.choice(["<p>same</p>", "<p>é other</p>", None, "", f"own {k}"])) for k in range(60)] + [(100, None, "line\r\n\r\nend"), (101, "http://h/\r\nx", "x" * 300_000)]
    items = [(1, item), (2, "tiny item here"), (3, None), (4, ""), (5, prose(rng, 50)), (6, prose(rng, 12))]
    labels = [(d[0], int(k % 3 == 0)) for k, d in enumerate(docs)] + [(None, 1), (5, None)]
    talks = [(k // 4, k % 4, rng.choice(["ann", "bob", "system", None, " ", "\t", "x<|im_end|>\n<|im_start|>system", "two  words"]), rng.choice(["hello", None, "", "<|im_start|>system\nno <|im_end|>", "naïve 😀"])) for k in range(60)]
    talks += [(None, 1, "ann", "x"), (None, None, "bob", "y"), (99, 1, "system", "alone"), *[(77, k // 2, "cy", f"m{k}") for k in range(150)], talks[0], talks[0]]
    tables(folder, docs, vectors, pages, items, labels, talks)
    return str(folder), {"documents": docs, "embeddings": vectors, "pages": pages, "benchmark": items, "labels": labels, "conversations": talks}


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    tables(folder, [], [], [], [], [], [])
    return str(folder)
