"""The pipeline's stages on a small corpus with planted cases, odd rows and clashing columns."""

import random

import pytest

import corpus_pipeline

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("bcdfglmnprstv") + RNG.choice("aeiou") for _ in range(RNG.randint(2, 4))) for _ in range(900)]
INSULT = ["vilescum", "rotfilth", "hatedreg"]


def prose(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def corpus():
    """Rows (doc_id, text), the ids that go in each stage, labels and benchmark items."""
    rows, toxic, labels = [], set(), []
    for i in range(1, 401):
        words = prose(60)
        if i % 4 == 0:
            for _ in range(6):
                words[RNG.randrange(60)] = RNG.choice(INSULT)
            toxic.add(i)
        labels.append((i, int(i % 4 == 0)))
        rows.append((i, " ".join(words)))
    text = dict(rows)
    long_text = " ".join(prose(40_000))
    rows += [(500, long_text), (501, "\n".join(long_text.split())), (502, text[1].replace(" ", "  ", 1)), (502, text[2])]
    near = text[3].split() + prose(2)
    rows += [(510, " ".join(near))]
    items = [" ".join(prose(30)) for _ in range(12)]
    rows += [(520 + k, " ".join(prose(20)) + " " + q + " answer was " + WORDS[k] + " " + " ".join(prose(20))) for k, q in enumerate(items[:3])]
    rows += [(None, " ".join(prose(50))), (530, None), (531, ""), (532, " \n ")]
    return rows, toxic, labels, [(k, q, WORDS[k]) for k, q in enumerate(items)]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("small"))
    rows, toxic, labels, items = corpus()
    names = "doc_id long, text string, `_metadata` string, `a``b` string, `__holdfast_row` int, `__holdfast_score` int, row_key string, digest string"
    spark.createDataFrame([(i, t, "m", "tick", k, 7, None, "d") for k, (i, t) in enumerate(rows)], names).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*r, r[1]) for r in labels] + [(None, 1, 1), (999, None, None)], "doc_id long, toxic int, quality int").write.parquet(f"{folder}/labels.parquet")
    like = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    kinds = {f.name: f.dataType.simpleString() for f in like.schema.fields}
    return folder, rows, toxic, items, kinds


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda v: (v is None, v or 0))


def test_stages_before_the_benchmark(spark, planted):
    folder, rows, toxic, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean, _ = corpus_pipeline.spill(corpus_pipeline.drop_toxic(spark, docs, folder), "test-clean")
    assert clean.columns == docs.columns
    gone = set(ids(docs)) - set(ids(clean))
    assert gone <= toxic and len(gone) >= 0.9 * len(toxic)
    single, _ = corpus_pipeline.spill(corpus_pipeline.drop_copies(spark, docs, folder), "test-single")
    assert single.columns == docs.columns
    # Of equal texts the longest stays, then the smallest id: 502 has one more blank than 1.
    assert sorted(map(str, ids(single))) == sorted(str(i) for k, (i, _) in enumerate(rows) if not (i in (1, 501, 530, 531) or i == 502 and k == 403))
    far, _ = corpus_pipeline.spill(corpus_pipeline.drop_near_copies(spark, single, folder), "test-far")
    assert far.columns == docs.columns
    assert set(map(str, ids(single))) - set(map(str, ids(far))) == {"510"}
    held = {r["__holdfast_row"] for r in far.collect()}
    assert len(held) == far.count()  # a column of the key's name keeps its values


def test_stages_on_an_empty_table(spark, planted):
    folder = planted[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        assert stage(spark, docs, folder).count() == 0
    assert corpus_pipeline.drop_benchmark(spark, docs, "/root/testdata/sf0.001").count() == 0
    assert corpus_pipeline.pack(spark, docs, folder).count() == 0


def test_benchmark_and_packing_stages(spark, planted):
    folder, rows, _, _, _ = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert ids(corpus_pipeline.drop_benchmark(spark, docs, "/root/testdata/sf0.001")) == ids(docs)
    pieces = corpus_pipeline.pack(spark, docs, folder).collect()
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)
    assert sum(1 for r in pieces if r.start == 0) == len(rows)
