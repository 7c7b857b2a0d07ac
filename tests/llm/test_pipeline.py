"""The pipeline's stages on a small table: what they must drop, cut and keep."""

import random

import pytest

import corpus_pipeline as cp


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(2)
    plain = ["".join(r.choices("mnopqrstu", k=r.randint(3, 8))) for _ in range(900)]
    text = lambda k: " ".join(r.choices(plain, k=k))
    docs = [(i, text(60)) for i in range(80)]
    for i in range(0, 80, 4):
        docs[i] = (i, docs[i][1] + " you idiot scum idiot")
    passage, item = text(60), text(25)
    docs += [(100, docs[1][1]), (101, docs[1][1] + " end"), (102, text(30) + " " + passage), (103, passage + "\n\n" + text(30)), (104, text(20) + " " + item + " " + text(20)), (105, ""), (106, None), (107, text(3000))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    return f"file://{at}", dict(docs), passage


def test_stages(spark, sf):
    at, texts, passage = sf
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns, kept = docs.columns, [set(texts)]
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, at).cache()
        assert docs.columns == columns, name
        kept.append({r.doc_id for r in docs.collect()})
    toxic = {i for i in range(0, 80, 4)}
    assert kept[1] == kept[0] - toxic
    # texts without words are not linked with anything
    assert kept[2] == kept[1] - {100, 101}
    assert kept[3] == kept[2] and kept[4] == kept[3] - {104}
    out = {r.doc_id: r for r in docs.collect()}
    assert out[102].text == texts[102] and passage not in out[103].text and out[103].n_chars == len(out[103].text) == len(texts[103]) - len(passage) - 2
    assert all(out[i].text == texts[i] for i in out if i != 103)


def test_run(spark, sf):
    got = cp.run(spark, sf[0]).collect()
    assert {r.doc_id for r in got} == {i for i in sf[1] if not (i < 80 and i % 4 == 0) and i not in (100, 101, 104)}
    assert all(len(r.ids_sha256) == 64 for r in got)


def test_empty(spark, sf, tmp_path):
    spark.read.parquet(f"{sf[0]}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf[0]}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert cp.run(spark, f"file://{tmp_path}").count() == 0


def test_rows_that_share_an_id_or_have_none(spark):
    a, b, z = ("x y z " * 3 + "{}").format("a b c d e f g"), "h i j k l m n o p", "q r s t u v w"
    rows = [(2, a, "en", "k"), (5, b, "en", "k"), (5, a, "en", "k"), (None, z, "en", "k"), (None, a, "en", "k"), (5, b, "de", "k"), (7, "", "en", "k"), (7, "", "en", "k"), (8, None, "en", "k"), (None, " ", "en", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, row string")
    got = cp.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    want = [(2, a, "en", "k"), (5, b, "de", "k"), (None, z, "en", "k"), *rows[6:]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_columns_of_any_name(spark, sf, tmp_path):
    at = f"file://{tmp_path}"
    names = ["_toxicity", "_key", "__span_at", "__span_id", "id", "key", "h", "at"]
    spark.read.parquet(f"{sf[0]}/documents.parquet").selectExpr("*", *[f"'{n}' as `{n}`" for n in names]).write.parquet(f"{at}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf[0]}/{t}.parquet").write.parquet(f"{at}/{t}.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, at).cache()
        assert docs.columns == columns, name
    assert all(r[n] == n for r in docs.collect() for n in names) and docs.count() == 65


def test_substrings_of_rows_that_share_an_id(spark):
    p, u = " ".join(f"p{k}" for k in range(13)), " ".join(f"u{k}" for k in range(20))
    rows = [(1, p), (2, p + " tail a b"), (2, u), (2, "x y " + p)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.substring_dedup(spark, docs, "").collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in got) == sorted((i, t, len(t)) for i, t in [(1, p), (2, "tail a b"), (2, u), (2, "x y")])


def test_columns_that_are_maps(spark, sf):
    docs = spark.read.parquet(f"{sf[0]}/documents.parquet").selectExpr("*", "map('k', doc_id) m", "array(map(1, text)) n", "struct(map(lang, 1) as a, 2 as b) o")
    docs = docs.union(docs.where("doc_id = 1"))
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf[0]).cache()
        assert docs.columns == columns, name
    assert docs.count() == 65 and docs.where("m['k'] <> doc_id").count() == 0
