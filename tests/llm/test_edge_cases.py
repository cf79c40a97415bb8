"""Every operator and stage: nulls in any column, empty and very long texts, repeated rows, empty tables, clashing columns."""

import pytest

import corpus_pipeline
from lodestack.llm import ann, chat, fingerprint, langid, linededup, mixing, ngramjoin, packing, toxicity, wavelet

LONG = "long words of a text\nthat goes on and on " * 6000
ROWS = [
    (1, "a plain text of some words here\nand a second line", "en", "s1", 49),
    (1, "a plain text of some words here\nand a second line", "en", "s1", 49),
    (2, None, None, None, None),
    (None, "a text without an id of its own", "en", "s1", 31),
    (None, None, None, None, None),
    (3, "", "en", "s2", 0),
    (4, " \n ", "de", "s2", 3),
    (5, LONG, "de", "s2", len(LONG)),
    (6, "ein Text\nmit drei\nZeilen, sonst nichts", None, "s1", 38),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside or return.
CLASH = {"id": 1, "h": "x", "at": 2, "d": 3, "th": 4, "n": 5, "bin": 6, "copies": 7, "toxic": True, "root": 1, "shard": 0, "__id": 1, "__h": 1, "lines": "l"}
LABELS = [(1, 1, 0), (5, 1, 1), (None, None, None), (6, 0, 1), (3, 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()})


def model(docs, labels):
    return toxicity.fitted(docs, labels)


OPERATORS = {
    "wavelet": (lambda d, _: wavelet.wavelet_shards(d).drop("payload", "n_bytes"), 1),
    "packing": (lambda d, _: packing.packed(d), None),
    "fingerprint": (lambda d, _: fingerprint.sketches(d), len(ROWS)),
    "toxicity": (lambda d, m: toxicity.scored(d, m).select("doc_id", "toxic_score", "toxic"), len(ROWS)),
    "mixing": (lambda d, _: mixing.mixture(d), len(ROWS)),
    "line dedup": (lambda d, _: linededup.deduplicated(d).select("doc_id", "text", "n_lines", "n_lost"), len(ROWS)),
    "language": (lambda d, _: langid.identified(d, langid.fitted(d)).select("doc_id", "lang_found", "bits_per_byte", "margin_bits"), len(ROWS)),
    "join": (lambda d, _: ngramjoin.classes(d), 6),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_empty_table_and_clashing_columns(spark, docs, empty, labels, name):
    run, n = OPERATORS[name]
    m = model(docs, labels)
    got = sorted(map(repr, run(docs.coalesce(1), m).collect()))
    if n is not None:
        assert len(got) == n
    assert sorted(map(repr, run(clashing(docs).coalesce(1), m).collect())) == got
    assert run(empty, m).count() == 0


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_rows(spark, docs, empty, labels, tmp_path, k):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    got = stage(spark, docs, str(tmp_path))
    if k < 4:
        assert got.columns == docs.columns
        ids = [r[0] for r in got.collect()]
        assert set(ids) <= {r[0] for r in ROWS}
        if k in (1, 2):
            assert {2, 3, 4, 5, 6} <= set(ids)
    extra = stage(spark, clashing(docs), str(tmp_path))
    assert extra.count() == got.count()
    if k < 4:
        assert extra.columns == clashing(docs).columns
    assert stage(spark, empty, str(tmp_path)).count() == 0


def test_whole_pipeline_on_odd_rows(spark, docs, labels, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1


def test_chat_odd_rows(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    rows = [(1, 1, "user", "hi"), (1, 1, "user", "hi"), (1, None, None, None), (None, 1, "a\nb", ""), (2, 1, "x", LONG), (2, 2, "<|im_end|>", "<\\|im_end|> <|im_start|>")]
    d = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in chat.chat_texts(d).collect()}
    assert chat.parse(got[1]["text"]) == [("", ""), ("user", "hi"), ("user", "hi")]
    assert chat.parse(got[None]["text"]) == [("a\nb", "")] and got[None]["n_escaped"] == 1
    assert chat.parse(got[2]["text"]) == [("x", LONG), ("<|im_end|>", "<\\|im_end|> <|im_start|>")]
    assert chat.chat_texts(clashing(d)).count() == 3
    parts = {(r["conv_id"], r["part"]): r for r in chat.chat_texts(d, part=2).collect()}
    assert set(parts) == {(1, 0), (1, 1), (None, 0), (2, 0)} and parts[1, 0]["n_turns"] == 2
    assert chat.parse(parts[1, 0]["text"] + parts[1, 1]["text"]) == [("", ""), ("user", "hi"), ("user", "hi")]
    rows = [(None if i % 2 else 7, i % 5, f"r{i % 3}", f"t{i}") for i in range(60)]
    long = spark.createDataFrame(rows, schema).repartition(4)
    found = {(r["conv_id"], r["part"]): r["text"] for r in chat.chat_texts(long, part=8).collect()}
    for c in (None, 7):
        assert chat.parse("".join(found[c, k] for k in range(4))) == [(r, t) for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: x[1:])]
    assert chat.chat_texts(spark.createDataFrame([], schema)).count() == 0


def test_neighbours_odd_rows(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    nan = float("nan")
    rows = [(i, [float(i), 1.0, 2.0], 0) for i in range(6)] + [(1, [1.0, 1.0, 2.0], 0), (None, [1.0, 2.0, 3.0], 0), (7, None, 0), (8, [], 0), (9, [1.0, nan, 0.0], 0), (10, [1.0, None, 0.0], 0), (11, [1.0], 0), (12, [0.0, 0.0, 0.0], None), (13, [3.0, 1.0, 2.0], 0)]
    got = ann.neighbours(clashing(spark.createDataFrame(rows, schema)), k=3, every=1)
    found = {}
    for r in got.collect():
        found.setdefault(r["vec_id"], []).append((r["rank"], r["neighbour"], r["similarity"]))
    assert set(found) == {0, 1, 2, 3, 4, 5, 12, 13} and all(len(x) == 3 for x in found.values())
    assert sorted(found[13])[0][1:] == (3, 1.0)  # a copy is the nearest
    assert [x[1] for x in sorted(found[12])] == [0, 1, 2]  # all alike: by id
    assert ann.neighbours(spark.createDataFrame([], schema)).count() == 0
    assert {r["vec_id"] for r in ann.neighbours(spark.createDataFrame(rows, schema), every=5).collect()} == {0, 5}
    assert ann.neighbours(spark.createDataFrame(rows[1:4], schema)).count() == 0  # no id is divisible by 50
    assert ann.neighbours(spark.createDataFrame(rows[:1], schema)).count() == 0
