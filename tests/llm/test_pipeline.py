import corpus_pipeline
from pyspark.sql import functions as F

from titlemart.llm import decontamination
from titlemart.llm.common import shared_table


def run_stages(spark, docs, sf_dir):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(shared_table(stage(spark, out[-1], sf_dir), name))
    return out


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    raw, told, lines, near, clean, packed = run_stages(spark, docs, sf_dir)
    for stage in (told, lines, near, clean):
        assert stage.columns == docs.columns and dict(stage.dtypes) == dict(docs.dtypes)
    assert told.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).count() == 0
    assert lines.count() == told.count() and near.count() < lines.count()
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert decontamination.matches(clean, bench).count() == 0 < decontamination.matches(near, bench).count()
    assert packed.select("doc_id").distinct().count() == clean.count()
    assert {tuple(r)[:5] for r in corpus_pipeline.run(spark, sf_dir).collect()} == {tuple(r)[:5] for r in packed.collect()}


def test_stages_of_odd_rows(spark, sf_dir, odd, none):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    stages = run_stages(spark, odd.select(*columns), sf_dir)
    assert 0 < stages[-2].count() <= stages[1].count() < odd.count()
    assert run_stages(spark, none.select(*columns), sf_dir)[-1].count() == 0


def test_repeated_rows_lose_several_lines_in_the_pipeline(spark, sf_dir):
    text = "shared by all\nown line {}\nalso shared\nshared by all\nthe end of {}"
    rows = [(d, text.format(d, d), "en", "s", 70) for d in [*range(12), 1, 1, 5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    done = corpus_pipeline.drop_repeated_lines(spark, df, sf_dir).collect()
    assert len(done) == len(rows) and all(r.text == f"own line {r.doc_id}\nthe end of {r.doc_id}" and r.n_chars == len(r.text) for r in done)


def test_stages_carry_columns_of_any_name(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    names = ["n_dropped", "kept_text", "lang_pred", "lang_score", "_text", "print", "row", "whole", "kept", "n"]
    named = docs.withColumns({c: F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")) for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, named, sf_dir)
        assert done.columns == named.columns
        rows = done.collect()
        assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in names)
