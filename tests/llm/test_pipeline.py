"""The pipeline against plain versions of its stages, over texts with planted cases."""

from collections import Counter

import brute
import corpus_pipeline
import public_tokenizers

from curvespace.llm import line_dedup, toxicity


def test_stages_keep_columns_and_order(spark, case):
    docs = spark.read.parquet(f"{case[0]}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, case[0]).columns == docs.columns


def test_empty_tables(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_run_is_what_the_plain_stages_give(spark, small):
    docs, labels, items = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    model = toxicity.fit(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    clean = []
    for i, t in rows:
        x = sum(model.weights.get(f, 0.0) for f in toxicity.features(t))
        if model.exceed([x])[0, 0] < toxicity.THRESHOLD:
            clean.append((i, t))
    assert len(clean) < len(rows)
    lined = brute.repeated_runs(clean)
    stay = {i for _, i in brute.near_copies(lined)}
    unique = [r for r in lined if r[0] in stay]
    assert len(unique) < len(lined)
    bench = [(r.item_id, r.text) for r in items.collect()]
    shingles = {s for _, t in bench for s in brute.runs(t, 5)}
    suspects = [r for r in unique if any(s in shingles for s in brute.runs(r[1], 5))]  # others share nothing with any item
    leaking = {r[0] for r in brute.leaks(suspects, bench)}
    assert leaking
    want = brute.pieces([r for r in unique if r[0] not in leaking], public_tokenizers.path("byte_bpe_50k.json"))
    got = corpus_pipeline.run(spark, small).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert Counter(map(tuple, got)) == Counter(want)


def test_line_stage_is_the_named_method(spark, case, monkeypatch):
    """Lines go by the chunks of the operator, not by a plainer way beside it."""
    ran, cut = [], line_dedup.cut_chunks
    monkeypatch.setattr(line_dedup, "cut_chunks", lambda *a: ran.append(a) or cut(*a))
    docs = spark.read.parquet(f"{case[0]}/documents.parquet")
    got = corpus_pipeline.dedup_lines(spark, docs, case[0])
    assert ran
    want = line_dedup.remove_repeated_chunks(docs)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
