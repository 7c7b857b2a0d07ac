"""Joins whose sides Spark takes for smaller than they are must not be broadcast."""

from tabulora.llm import lm, spelling
from tabulora.llm.common import Work


def test_words_of_the_language_model_are_not_broadcast(spark, monkeypatch, tmp_path):
    spark.range(50).selectExpr("id v", "id + 1 main").write.parquet(f"{tmp_path}/words")
    spark.range(50).selectExpr("(id + 49) % 50 u", "id v", "(id + 1) % 50 w", "id + 1 main", "2L held").write.parquet(f"{tmp_path}/held")
    words, held = spark.read.parquet(f"{tmp_path}/words"), spark.read.parquet(f"{tmp_path}/held")
    plans, kind = [], type(words)
    plain = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: plans.append(self._jdf.queryExecution().sparkPlan().toString()) or plain(self))
    weights = lm.find_weights(held.select("v", "w", "main", "held"), words)
    assert lm.find_trigram_weights(held.where("v > 0"), held.select("v", "w", "main", "held"), words, weights) and weights
    asked = [p for p in plans if "Join" in p]
    assert len(asked) == 2 and not any("Broadcast" in p for p in asked)


def test_made_neighbours_are_not_broadcast(spark):
    work = Work(spark, "test")
    vocab = work.write(spark.createDataFrame([("birch", 3), ("birth", 9), ("berth", 4)], "word string, n long"), "vocab")
    out = spelling.neighbours(work, vocab)
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    assert {tuple(r) for r in out.collect()} == {("birch", "birth", 9), ("birth", "birch", 3), ("birth", "berth", 4), ("berth", "birth", 9)}
    work.close()
