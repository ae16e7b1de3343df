"""The pipeline, and what all operators share: staged tables, batches, odd inputs of every stage."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexispark.llm import common, decontaminate, jaccard, packing, pii, token_counts, toxicity
from tests.llm.test_llm import ODD, SCHEMA, none, odd


def folders(spark):
    root = common.shared_dir(spark).removeprefix("file://")
    return set(os.listdir(root))


def clashing(spark):
    """Odd rows with columns of names that operators use themselves."""
    names = ["rank", "slot", "slots", "_salt", "ids", "n", "rep", "cosine", "score", "y", "key", "text_crc32", "component_id"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in ODD], SCHEMA)
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names)))


def test_pipeline_of_odd_rows(spark, sf):
    import corpus_pipeline as p

    before = folders(spark)
    out = p.run_over(spark, clashing(spark), sf)
    rows = out.collect()
    # one of the copies 4 and 5 stays; the rest is packed, whole
    assert sorted(str(x.doc_id) for x in rows if x.piece == 0) == sorted(["1", "2", "3", "4", "6", "7", "8", "None"])
    assert folders(spark) - before == {os.path.basename(x.split("/part-")[0]) for x in out.inputFiles()}
    empty = p.run_over(spark, none(spark), sf)
    assert empty.columns == out.columns and empty.count() == 0


@pytest.mark.parametrize("make", [clashing, none])
def test_stages_keep_all_columns(spark, sf, make):
    import corpus_pipeline as p

    docs = make(spark)
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes), name
        assert got.count() == docs.count() - (3 if name == "near_duplicates" and make is clashing else 0) + (1 if name == "near_duplicates" and make is clashing else 0)


def test_pack_refuses_columns_that_it_makes(spark):
    parts = packing.pieces(odd(spark))
    with pytest.raises(ValueError, match="offset"):
        packing.pack(parts.withColumn("offset", F.lit(0)))
    out = packing.pack(parts.withColumn("rank", F.lit(7)).withColumn("slots", F.lit("x")))
    assert {(x["rank"], x.slots) for x in out.collect()} == {(7, "x")} and out.columns[-2:] == ["sequence_id", "offset"]


def test_equal_rows_are_ranked_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "RANKED_ROWS", 10)
    docs = spark.createDataFrame([(1, "same text")] * 300, "doc_id long, text string")
    ranked = common.gapless(packing.pieces(docs).withColumn("g", F.lit(1)), "g", ["doc_id", "piece", "turn"], 300, "at")
    assert sorted(x["at"] for x in ranked.collect()) == list(range(300))
    salts = packing.pieces(docs).select(F.pmod(F.xxhash64("doc_id", "piece", "turn"), F.lit(34)).alias("s")).distinct().count()
    assert salts > 10


def test_batches_are_cut_by_rows_and_bytes(spark):
    """Whatever other operators are built, and whatever the session says, a plan runs with its own bounds."""
    docs = spark.range(2500).select(F.lit("x" * 100).alias("text")).coalesce(1)
    sizes = lambda: lambda batch: {"n": [batch.num_rows], "size": [batch.nbytes]}
    small = common.arrow_rows(docs, sizes, "n long, size long", batch_rows=100)
    common.arrow_rows(docs, sizes, "n long, size long", batch_rows=2000)
    for setting in (None, "7", "0"):
        key = "spark.sql.execution.arrow.maxRecordsPerBatch"
        spark.conf.unset(key) if setting is None else spark.conf.set(key, setting)
        rows = small.collect()
        assert max(x.n for x in rows) == min(100, int(setting or 100) or 100) and sum(x.n for x in rows) == 2500
        spark.conf.unset(key)
    long = spark.range(60).select(F.repeat(F.lit("long text "), 100_000).alias("text")).coalesce(1)
    rows = common.arrow_rows(long, sizes, "n long, size long").collect()
    assert sum(x.n for x in rows) == 60 and max(x["size"] for x in rows) <= common.BATCH_BYTES
    batch = pa.RecordBatch.from_pydict({"a": ["x" * 10, "y" * 100_000, "", None]})
    assert [b.num_rows for b in common.slices(batch, 10, 1000)] == [1, 1, 2] and pa.Table.from_batches(common.slices(batch, 10, 1000)).to_pydict() == batch.to_pydict()


def test_scopes_drop_what_is_staged_within(spark):
    before = folders(spark)
    with common.staging():
        common.Staged(spark.range(3), "inner")
        kept = common.Staged(spark.range(4), "kept")
        kept.keep()
        assert len(folders(spark) - before) == 2
    assert len(folders(spark) - before) == 1 and kept.df.count() == 4
    kept.drop()
    assert folders(spark) == before


def test_a_cluster_must_name_its_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext = Context()

    with pytest.raises(ValueError, match=r"spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_operators_leave_only_what_their_result_reads(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    for make, left in ((lambda: decontaminate.find_leaks(docs, bench), 1), (lambda: jaccard.near_duplicates(docs), 2), (lambda: packing.pack_documents(docs), 1), (lambda: token_counts.count_after_sample_edits(docs), 1), (lambda: toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet")), 0)):
        before = folders(spark)
        make()
        assert len(folders(spark) - before) <= left
    assert pii.mask_personal(clashing(spark)).columns == clashing(spark).columns
