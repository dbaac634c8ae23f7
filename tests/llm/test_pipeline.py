"""The pipeline on a small fixture, stage by stage."""

import hashlib

import corpus_pipeline
from cohortlens.llm import bpe


def test_stages(spark, tmp_path):
    from test_operators import ODD, words

    rows = [(1000 + i, f"{words(40, i)}\nthe very same footer line here", "en" if i % 2 else "de", f"src{i % 6}", 1) for i in range(90)]
    rows += [(100 + i, f"{words(80, 5)} tail{i}", "en", "src1", 1) for i in range(6)] + [r for r in ODD if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept.append(now.count())
        if name != "byte_bpe":
            assert now.columns == docs.columns
    ids = {r.doc_id for r in spark.read.parquet(str(tmp_path / "near_dedup")).collect()}
    assert len(ids & set(range(100, 106))) == 1 and not ids & {1, 2, 3}
    text = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "line_dedup")).collect()}
    assert sum("footer" in (t or "") for t in text.values()) == 1
    assert kept[0] >= kept[1] >= kept[2] >= kept[3] == kept[4] and kept[3] < kept[2]
    coder = bpe.load(*bpe.vocabulary_paths())
    mixed = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "mixing")).collect()}
    for r in now.collect():
        assert r.ids_sha256 == hashlib.sha256(coder.encode(mixed[r.doc_id])).hexdigest() and r.decoded_sha256 == hashlib.sha256(mixed[r.doc_id].encode()).hexdigest()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[4]
