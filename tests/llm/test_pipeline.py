"""The pipeline's stages on a small fixture, each against what it should do to its input."""

from frames import DATA

import corpus_pipeline
from tabulens.llm import line_dedup, mixing, quality


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    wanted = {r.doc_id for r in quality.judge(docs).where("kept").select("doc_id").collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{len(seen)}")
        out = spark.read.parquet(f"{tmp_path}/{len(seen)}")
        seen.append((name, docs, out))
        docs = out
    (_, _, good), (_, lines_in, lines), (_, near_in, near), (_, mix_in, mixed), (_, pack_in, packed) = seen
    assert all(df.columns == columns for df in (good, lines, near, mixed))
    assert {r.doc_id for r in good.collect()} == wanted
    assert {r.doc_id: r.text for r in lines.collect()} == {r.doc_id: r.text for r in line_dedup.lines_report(lines_in).collect()}
    from test_near_dedup import brute

    groups = brute([(r.doc_id, r.text) for r in near_in.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, c in groups.values()})
    copies = {r.doc_id: r.copies for r in mixing.mixture(mix_in).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    from test_models_and_files import check_pieces

    check_pieces(packed.collect(), [(r.doc_id, r.text) for r in pack_in.collect()])


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns) and out.count() > 0
