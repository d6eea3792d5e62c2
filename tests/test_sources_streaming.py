import json

import pytest

from lodestrata.operators import inference
from lodestrata.plans import sweep
from lodestrata.sources import tables
from lodestrata.streaming import updates


def test_links_keep_the_chain(spark):
    got = {(r["arm"], r["depth"]): r["recovery"] for r in sweep.e2e_depth_crossover(spark, "").collect()}
    assert all(got["walk", d] >= 0.9 and got["none", d] == 0 for d in (1, 2, 3))
    assert got["words", 1] >= 0.8 > got["words", 3]


def test_streamed_capital_is_the_batch_one(spark, tmp_path):
    rows = [(k, n, ((k * 7 + n * 13) % 10) / 10) for k in range(3) for n in range(40)]
    for part in range(4):
        spark.createDataFrame(rows, "key long, nth long, x double").where(f"nth >= {part * 10} and nth < {part * 10 + 10}").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema("key long, nth long, x double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = updates.running_capital(stream, 0.3, 1.0).writeStream.outputMode("update").format("memory").queryName("caps").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = {r["key"]: r["capital"] for r in spark.sql("select key, max_by(capital, n) as capital from caps group by key").collect()}
    path = inference.betting_path(spark.createDataFrame(rows, "key long, nth long, x double"), 0.3, 1.0)
    want = {r["key"]: r["capital"] for r in path.where("nth = 39").collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_loaders(spark, tmp_path):
    sessions = [{"session_id": f"s{i}", "turns": [{"role": "user", "content": f"text {i}"}]} for i in range(3)]
    (tmp_path / "d.json").write_text(json.dumps({"examples": [{"question_id": "q", "question": "?", "answer": "!", "gold_session_id": "s1", "sessions": sessions}]}))
    got = tables.read_sessions(spark, str(tmp_path / "d.json")).orderBy("pos").collect()
    assert [r["text"] for r in got] == ["user: text 0", "user: text 1", "user: text 2"] and {r["depth"] for r in got} == {2}
    (tmp_path / "dec.json").write_text(json.dumps({"decisions": [{"id": "a", "decision": "A"}, {"id": "b", "decision": "B"}]}))
    (tmp_path / "t.json").write_text(json.dumps({"tasks": [{"task_id": "t", "prompt": "p", "gotchas": [{"decision_id": "b"}, {"decision_id": "a"}, {"decision_id": "b"}]}]}))
    assert tables.read_decisions(spark, str(tmp_path / "t.json"), str(tmp_path / "dec.json")).first()["decision_texts"] == ["B", "A"]
    with pytest.raises(ValueError):
        tables.Config(["d"], ["a"], {}).validate()
    assert tables.Config(["d"], ["a", "b"], {"d": 5}).grid(spark).count() == 2
