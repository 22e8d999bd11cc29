"""The pipeline's stages on a small corpus, each held against what it should do to its own input."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from quarrymill.llm import common


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = [f"{a}{b}o" for a in "bcdfglmnprst" for b in ("ai", "eo", "ur", "in", "as")]
    line = lambda k=12: " ".join(rng.choice(vocabulary) for _ in range(k))
    good = {i: "\n".join(line() for _ in range(8)) for i in range(200)}
    common = line(20)
    rows = [(i, f"{common}\n{t}" if i % 2 else t) for i, t in good.items()]
    rows += [(1000 + i, " ".join(w.upper() + "!!" for w in line(60).split())) for i in range(100)]
    rows += [(2000 + i, good[2 * i] + " tail") for i in range(20)]
    rows += [(3000, None), (3001, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 1000)) for i, _ in rows if i < 2000], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[-1], str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{i}"))
        seen.append(spark.read.parquet(str(tmp_path / f"out{i}")))
        if i < 4:
            assert seen[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in seen]
    assert ids[1] >= set(good) and not any(1000 <= i < 1100 for i in ids[1])
    lines = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    assert sum(common in (t or "") for t in lines.values()) == 1 and ids[2] == ids[1]
    assert seen[2].where(F.col("n_chars") != F.length("text")).count() == 0
    assert not any(2000 <= i < 2020 for i in ids[3]) and ids[3] >= set(good)
    mixed = seen[4].agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0]
    kept = sum(len((r["text"] or "").split()) for r in seen[3].collect())
    assert abs(mixed - 1.5 * kept) < 0.05 * kept
    last = corpus_pipeline.run(spark, str(tmp_path))
    assert last.count() == seen[5].count() > 0 and "sequence_id" in last.columns


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_from_four_fifths(spark):
    words = [f"w{i}" for i in range(124)]
    texts = [words, [*words[:20], "x", *words[21:100], "y", *words[101:]], [*words[:20], "x", *words[21:60], "y", *words[61:100], "z", *words[101:]]]
    sets = [{tuple(t[k : k + 5]) for k in range(120)} for t in texts]
    alike = [len(sets[0] & x) / len(sets[0] | x) for x in sets]
    assert 0.8 <= alike[1] < 0.85 and alike[2] < 0.8
    for other, kept in ((1, {0}), (2, {0, 2})):
        docs = spark.createDataFrame([(i, " ".join(texts[i])) for i in (0, other)], "doc_id long, text string")
        assert {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == kept


def test_stages_leave_only_what_their_results_read(spark, tmp_path, monkeypatch):
    """All other tables would stay on disk through the stages that follow."""
    made = []
    monkeypatch.setattr(common, "_made", made)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, "\n".join(" ".join(words[(k + 7 * (i // 2)) % 180 :][:12]) for k in range(9)), "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for stage, most in ((corpus_pipeline.line_stage, 2), (corpus_pipeline.near_duplicate_stage, 1)):
        made.clear()
        out = stage(spark, docs, "")
        left = [p for _, base in made for p in Path(base.removeprefix("file://").removeprefix("file:")).glob("*")]
        assert out.count() > 0 and 0 < len(left) <= most
