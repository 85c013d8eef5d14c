import public_tokenizers

import corpus_pipeline
from lightloom.llm import tokens

from .corpus import SCHEMA, documents


def test_stages(spark, tmp_path):
    rows = documents()
    planted = (600, "benchmark words " + " ".join(f"w{k}" for k in range(20)) + " the and of is the", "en", "src0", 1, "", 0, "")
    spark.createDataFrame([*rows, planted], SCHEMA).drop("d", "size", "key").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    counts = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        counts.append({r.doc_id for r in docs.collect()})
    assert counts[0].isdisjoint({200, 201, 202, 203})  # no language
    assert 204 not in counts[1] and 5 in counts[1]  # a copy
    assert 600 in counts[1] and 600 not in counts[2]  # contaminated
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in final} == counts[3]
    encoder = tokens.PieceEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.n_tokens == len(encoder.encode([texts[r.doc_id]])[0]) for r in final)


def test_empty_tables_and_odd_rows(spark, tmp_path):
    """No rows; and nulls in every column, repeated rows and ids, a benchmark without words."""
    table = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(tmp_path / name))
    table([], SCHEMA, "documents.parquet")
    table([], "item_id long, text string", "benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rows = documents()
    odd = [(None, rows[6][1] + " more words here", "en", None, None, None, None, None), (6, rows[6][1], None, "src0", None, "", 1, ""), rows[6]]
    table([*rows, *odd], SCHEMA, "documents.parquet")
    table([(1, None), (2, ""), (3, " .,")], "item_id long, text string", "benchmark.parquet")
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 6 in {r.doc_id for r in final} and [r.start for r in final if r.doc_id is None][:1] in ([0], [])
    assert sorted(r.start for r in final)[0] == 0 and sum(r.n_tokens for r in final) == max(r.start + r.n_tokens for r in final)
