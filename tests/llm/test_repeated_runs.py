"""The pipeline's line stage and the removal of chunks against a plain search for repeated runs of lines."""

import random

import brute
import corpus_pipeline
import pytest
from curvespace.llm import line_dedup


@pytest.fixture(params=["stage", "chunks", "wide chunks"])
def stage(request):
    """The pipeline's stage, and the removal of chunks cut finely and coarsely: one result."""

    def run(spark, rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        if request.param == "stage":
            return [tuple(r) for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()]
        return [tuple(r) for r in line_dedup.remove_repeated_chunks(docs, divisor=3 if request.param == "chunks" else 1000).collect()]

    return run


def order(rows):
    return sorted(rows, key=repr)


def test_runs_between_other_lines_go(spark, stage):
    rng = random.Random(5)
    line = lambda n=6: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    two, nine, wide, short = [line(), line()], [line() for _ in range(9)], line(60), line(50)
    rows = [(k, "\n".join([line(), *body, line()])) for k, body in enumerate([two, nine, [wide], [short], two, nine, nine[3:7], [wide], [short], [*two, *nine]])]
    got = dict(stage(spark, rows))
    for k in (4, 5, 6, 7, 9):
        a, *_, b = rows[k][1].split("\n")
        assert got[k] == f"{a}\n{b}"
    assert all(got[k] == rows[k][1] for k in (0, 1, 2, 3, 8))


def test_as_a_plain_search(spark, stage):
    rng = random.Random(6)
    pool = [f"line {k}" for k in range(30)] + ["", " \t", " ".join("v" * 51), " ".join("v" * 50), "é 東京"]
    rows = [(k, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for k in range(120)]
    rows += [(500, None), (501, ""), (502, "\n\n\n"), (503, "a\na\na\na"), (504, "b\n\n\nc"), (505, "b\n\n\nc"), (None, rows[0][1])]
    assert order(stage(spark, rows)) == order(brute.repeated_runs(rows))


def test_a_passage_in_most_documents(spark, stage, monkeypatch):
    monkeypatch.setattr(line_dedup, "COPIES", 100)  # copies of one chunk go to many tasks
    rows = [(k, f"top {k}\nfirst shared\nsecond shared\nend {k}") for k in range(1500)]
    assert order(stage(spark, rows)) == order([rows[0], *((k, f"top {k}\nend {k}") for k in range(1, 1500))])


def test_chunks_are_coarse_where_passages_are_long(spark):
    """A passage of 64 lines in two documents is a few coarse chunks; its bounds do not move with what stands before it."""
    rng = random.Random(9)
    body = [f"line {rng.randrange(10**9)}" for _ in range(64)]
    df = spark.createDataFrame([(1, "\n".join(["a", *body, "z"])), (2, "\n".join(["q", "r", "s", *body, "y"]))], "doc_id long, text string")
    rows = line_dedup.cut_chunks(df, "text", 8, 50, "c").collect()
    one, two = ({bytes(c.key) for c in r.c if c.cut is None} for r in rows)
    assert len(one) < 20
    assert len(one & two) >= len(one) - 3
    for r in rows:
        pairs = sorted(c.k for c in r.c if c.cut is not None)
        assert pairs == list(range(len(r.text.split("\n")) - 1))
