import random

from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm.common import ship


def test_stages_keep_and_drop_what_they_should(spark, tmp_path):
    ship(spark)
    rng = random.Random(14)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqrst") + rng.choice("uvwxyzaei")
    text = lambda n=60: " ".join(word() for _ in range(n))
    rows = [(i, text(), "en", 0) for i in range(700)]
    rows += [(i, text() + " stupid idiot moron " + text(5), "en", 1) for i in range(700, 900)]
    near = rows[5][1].split()
    rows.append((900, " ".join([*near[:-1], "other"]), "en", 0))
    rows.append((901, rows[6][1], "en", 0))
    rows.append((902, "too short", "en", 0))
    rows.append((903, None, None, 0))
    docs = [(i, t, lang, f"src{i % 3}", len(t or "")) for i, t, lang, _ in rows]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, toxic) for i, _, _, toxic in rows if i < 890]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left, kept = frame, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == frame.columns and [f.dataType for f in left.schema] == [f.dataType for f in frame.schema]
        kept.append({r.doc_id for r in left.collect()})
    assert kept[0] & set(range(700, 900)) == set() and len(kept[0] & set(range(700))) >= 690
    assert kept[1] == kept[0] - {902, 903}
    assert kept[2] == kept[1] - {900, 901}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == kept[2]


def test_edges_of_every_stage(spark, tmp_path):
    """Empty tables, repeated rows, null ids and texts, very long texts, and columns named like those that stages work with."""
    ship(spark)
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    one, long = text(60), text(20_000)
    rows = [(i, text(40), "en", 1.0, "r", 5, "l", i, "c", 2) for i in range(60)]
    rows += [(None, one, None, 1.0, "r", 5, "l", 0, "c", 2)] * 3 + [(7, one, "en", None, None, None, None, None, None, None)] + [(8, long, "de", 1.0, "r", 5, "l", 0, "c", 2)] * 2
    rows += [(9, None, None, None, None, None, None, None, None, None), (None, "", "en", 1.0, "r", 5, "l", 0, "c", 2)]
    schema = "doc_id long, text string, lang string, score double, row string, slot int, label string, n_tokens int, stratum string, node int"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, left.limit(0), str(tmp_path)).count() == 0
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
    got = [(r.doc_id, r.text) for r in left.collect()]
    # of the rows with the one text the smallest id stays; repeated rows are one; what has no words fails the quality rules
    assert sorted(x for x, _ in got if x is not None) == sorted([*range(60), 7, 8]) and not any(x is None for x, _ in got)
    assert sorted(t for i, t in got if i in (7, 8)) == sorted([one, long, rows[7][1], rows[8][1]])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(got)
    assert corpus_pipeline.STAGES[-1][1](spark, left.limit(0), str(tmp_path)).count() == 0
