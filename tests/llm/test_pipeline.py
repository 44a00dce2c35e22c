"""The whole pipeline on a small table with empty, null, repeated and clashing input, stage by stage."""

import collections

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, kinds string, class_id long, sequence_id long"


def test_pipeline(spark, tmp_path):
    words = [f"{a}{b}" for a in ("ba", "ce", "do", "fu") for b in ("lan", "mer", "nis", "pot", "rug")]
    text = lambda k: " ".join(words[(i * i * k + i) % 20] + str((i * k) % 7) for i in range(80))
    item = "which planet of the system has the largest ring and the most moons today. the answer is saturn then."
    texts = [text(3), text(3), text(3).replace("0", "0", 1) + " tail", text(5), f"{text(7)} {item} {text(11)}", None, "", "12 34", text(13) + " mail bob.1@x.example.com", text(17), " ".join(text(19 + k) for k in range(60))]
    rows = [(i, t, "en", "s", len(t or ""), "x", -1, -2) for i, t in enumerate(texts)] + [(9, texts[9], "en", "s", 1, "x", -1, -2)]
    folder = tmp_path / "sf"
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(folder / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(folder / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, str(folder)), name)
        assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        kept[name] = collections.Counter(r["doc_id"] for r in docs.collect())
    assert set(kept["language_id"]) == set(range(11)) - {5, 6, 7}
    assert set(kept["near_copies"]) == set(kept["language_id"]) - {1, 2}
    assert set(kept["decontamination"]) == set(kept["near_copies"]) - {4}
    assert kept["surrogates"] == kept["decontamination"]
    new = {r["doc_id"]: r for r in docs.collect()}
    assert "bob.1@x" not in new[8]["text"] and new[8]["n_chars"] == len(new[8]["text"]) and new[3]["text"] == texts[3]
    packed = corpus_pipeline.run(spark, str(folder)).collect()
    assert {r["doc_id"] for r in packed} == set(kept["surrogates"]) and all(0 < r["length"] <= 2048 for r in packed)
    for r in packed:
        before = sum(x["length"] for x in packed if x["sequence_id"] == r["sequence_id"] and x["offset"] < r["offset"])
        assert before == r["offset"]


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_decontamination_fits_its_basis_on_all_passages(spark, tmp_path, monkeypatch):
    """3,000 documents with 27,000 passages: the words of all of them get to the basis, not those of about 20,000 passages."""
    from annoquery.llm import decontaminate

    spark.createDataFrame([(1, "w1 w2 w3 w4 w5 w6. w7 w8 w9.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 31 + j * j) % 5000}" for j in range(160))) for i in range(3000)], "doc_id long, text string").repartition(4)
    seen, fit = [], decontaminate.latent_basis

    def watched(features, *rest):
        seen.extend(int(np.frombuffer(r["sizes"], np.int32).sum()) for r in features.select("sizes").collect())
        return fit(features, *rest)

    monkeypatch.setattr(decontaminate, "latent_basis", watched)
    assert corpus_pipeline.decontamination(spark, docs, str(tmp_path)).count() == 3000
    assert sum(seen) == 3000 * 160
