import json

import pytest
from pyspark.sql import functions as F

from winnow.functions.entities import explode_entities
from winnow.functions.text import tiers, token_count
from winnow.operators import results as R
from winnow.operators import scorers as S
from winnow.operators.selection import select_turns
from winnow.plans.compact import compact
from winnow.sources import sessions, sinks
from winnow.streaming.watcher import events


def user(text, **more):
    return {"type": "user", "message": {"role": "user", "content": text}, **more}


def said(*blocks):
    return {"type": "assistant", "message": {"content": list(blocks)}}


def turns_of(spark, tmp_path, fmt, rows):
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return sessions.read_turns(spark, str(path), fmt).orderBy("turn_index").collect()


def test_block_turns(spark, tmp_path):
    rows = [
        said({"type": "text", "text": "hello"}), user("a"), user("b"), "", "not json", "[1]", {"type": "progress"},
        said({"type": "tool_use", "name": "Run", "input": {"z": 1, "a": {"k": True, "n": None}, "long": "x" * 600}}),
        {"type": "user", "message": {"content": [{"type": "tool_result", "content": [{"type": "text", "text": "done"}]}]}},
        user("from tool", sourceToolAssistantUUID="u"), user([{"type": "text", "text": "c"}]), {"type": "user", "message": None},
    ]
    got = turns_of(spark, tmp_path, "blocks", rows)
    assert [t.kind for t in got] == ["system", "user", "user", "system", "user", "system"]
    assert [t.turn_index for t in got] == list(range(6))
    text = got[3].text
    assert text.startswith("[tool_use: Run]\n  z: 1\n  a: {'k': True, 'n': None}\n  long: " + "x" * 500 + "...\ndone\nfrom tool")
    assert got[3].lines[0] == json.dumps(rows[7])


def item(role, *texts):
    return {"type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "input_text", "text": t} for t in texts]}}


def test_rollout_turns(spark, tmp_path):
    rows = [
        {"type": "session_meta", "payload": {"id": 1}}, {"type": "turn_context", "payload": {"user_instructions": "be brief"}}, item("user", "one"), item("user", "two"),
        item("developer", "rules"), {"type": "response_item", "payload": {"type": "function_call", "name": "f", "arguments": "y" * 600}},
        {"type": "compacted", "payload": {"message": "short"}}, {"type": "response_item", "payload": {"type": "reasoning", "summary": [{"text": "why"}]}}, "{bad",
        {"type": "event_msg", "payload": {}}, {"type": "turn_context", "payload": {}}, {"type": "turn_context", "payload": {}},
    ]
    got = turns_of(spark, tmp_path, "rollout", rows)
    assert [t.kind for t in got] == ["user", "system", "system", "system", "user", "user"]
    assert got[0].text == "be brief\none\ntwo" and got[2].text == "short" and got[3].text == "why"
    assert "[function_call: f]" in got[1].text and got[1].text.endswith("y" * 500 + "...")


@pytest.mark.parametrize("fmt", ["blocks", "rollout"])
def test_empty_session(spark, tmp_path, fmt):
    assert turns_of(spark, tmp_path, fmt, [""]) == []


def test_listing_and_fingerprint(spark, tmp_path):
    import hashlib

    data = b"x\n" * 5000
    (tmp_path / "a.jsonl").write_bytes(data)
    found = sessions.files(spark, str(tmp_path))
    assert sessions.newest(found, least=3).first().lines == 5000
    assert sessions.latest(found).first().path.endswith("a.jsonl")
    want = hashlib.sha256(str(len(data)).encode() + b"0.7000" + data[:4096] + data[-4096:]).hexdigest()[:16]
    assert sessions.fingerprint(found, 0.7).first().conv_hash == want


def test_entities(spark):
    text = "see https://a.io/x/y). then /srv/app/m.py: port 8080, host:443 and x:70000 404 Not Found KeyError run_it (1) CamelCase\n$ git commit now\npip install foo APP_KEY=1 HOME /http/é"
    rows = {(r.etype, r.value) for r in explode_entities(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).collect()}
    assert {("url", "https://a.io/x/y"), ("file_path", "/srv/app/m.py"), ("port", "8080"), ("http_status", "404"), ("exception", "keyerror"), ("function", "run_it"), ("class_name", "camelcase"), ("package", "foo"), ("env_var", "app_key"), ("file_path", "/http/é")} <= rows
    assert not any(v in ("443", "70000", "home", "/x/y") for _, v in rows)
    assert any(t == "command" and v.startswith("git commit") for t, v in rows)


def test_greedy_passes_over_and_takes_later(spark):
    rows = [(1, 0, "user", 5, "user"), (1, 1, "system", 60, "long"), (1, 2, "system", 50, "long"), (1, 3, "system", 30, "long"), (1, 4, "system", 10, "long")]
    turns = spark.createDataFrame(rows, "conv_id long, turn_index long, kind string, tokens long, tier string")
    scores = spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.9), (1, 3, 0.1), (1, 4, 0.5)], "conv_id long, turn_index long, score double")
    kept = {r.turn_index: (r.kept, r.reason) for r in select_turns(turns, scores, 110).collect()}
    assert kept == {0: (True, "user"), 1: (True, "fits"), 2: (False, "dropped"), 3: (True, "fits"), 4: (True, "last")}
    none = {r.turn_index for r in select_turns(turns, scores, 3).collect() if r.kept}
    assert none == {0, 4}


def test_duplicate_share_against_brute_force(spark):
    import random

    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    frame = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(texts)], "conv_id long, turn_index long, text string")
    for r in S.duplicate_share(frame, length=6, block=4).collect():
        own = [t for i, t in enumerate(texts) if i % 3 == r.conv_id]
        windows = [t[i : i + 6] for t in own for i in range(len(t) - 5)]
        t, marks = texts[r.turn_index], set()
        for i in range(len(t) - 5):
            if windows.count(t[i : i + 6]) > 1:
                marks.update(range(i, i + 6))
        assert r.n_duplicated == len(marks)


def test_duplicate_share_of_odd_texts(spark):
    schema = "conv_id string, turn_index int, text string, p int, n int"
    same = "\U0001f600" * 3 + "abcdefgh"
    rows = [("a", 0, None, 1, 1), ("a", 1, "", 1, 1), ("a", 2, "x" + same, 1, 1), ("a", 3, same + "y", 1, 1), ("b", 0, same, 1, 1), ("b", 1, "z" * 30, 1, 1), (None, 0, same, 1, 1)]
    got = {(r.conv_id, r.turn_index): (r.n_chars, r.n_duplicated) for r in S.duplicate_share(spark.createDataFrame(rows, schema), length=6, block=5).collect()}
    assert got == {("a", 0): (None, 0), ("a", 1): (0, 0), ("a", 2): (12, 11), ("a", 3): (12, 11), ("b", 0): (11, 0), ("b", 1): (30, 30), (None, 0): (11, 0)}
    assert S.duplicate_share(spark.createDataFrame([], schema)).collect() == []


def test_models_are_pluggable(spark):
    turns = spark.createDataFrame([("c", 0, "user", "q", 1, "user"), ("c", 1, "system", "aa", 9, "long"), ("c", 2, "system", "b", 9, "long")], "conv_id string, turn_index long, kind string, text string, tokens long, tier string")
    queries = spark.createDataFrame([("c", "q")], "conv_id string, query string")
    got = {r.turn_index: r.score for r in S.embedded(turns, queries, lambda xs: [[1.0, float(len(x) - 1)] for x in xs]).collect()}
    assert got[2] == pytest.approx(1.0) and got[1] < got[2]
    assert {r.turn_index: r.score for r in S.reranked(turns, queries, lambda q, xs: {0: 0.5}).collect()} == {1: 0.5, 2: 0.0}
    assert S.summarised(turns, 10, lambda text, n: f"{n}:{text[:6]}").first().text == "10:[USER "
    with pytest.raises(ValueError):
        S.scorer("nothing")


def test_embedding_scorers_get_whole_queries_and_instructions(spark):
    turns = spark.createDataFrame([("c", 1, "system", "d" * 2048 + "END", 9, "long")], "conv_id string, turn_index long, kind string, text string, tokens long, tier string")
    queries = spark.createDataFrame([("c", "q" * 3990 + "END")], "conv_id string, query string")

    def embed(texts):  # (1, 0) for what is expected of both, (0, 1) or (1, 1) otherwise
        return [[float(x.startswith("Instruct: Find assistant responses") or x.startswith("Instruct: AI coding assistant response")), float(not x.endswith("END"))] for x in texts]

    assert S.scorer("embed")(turns, queries, embed).first().score == pytest.approx(1.0)
    assert S.scorer("http-embed")(turns, queries, embed).first().score == pytest.approx((0.5**0.5 + 1) / 2)


def test_sinks_and_compact(spark, tmp_path):
    rows = [("c", 0, "user", ["u"], "do it"), ("c", 1, "system", ["s1", "s2"], "ValueError " * 200), ("c", 2, "system", ["s3"], "tail")]
    turns = spark.createDataFrame(rows, "conv_id string, turn_index long, kind string, lines array<string>, text string").withColumn("tokens", token_count(F.col("text")))
    out = compact(turns, budget=100, threshold=20)
    assert {r.turn_index for r in out.where("kept").collect()} == {0, 2}
    head = spark.createDataFrame([("c", "meta")], "conv_id string, raw string")
    sinks.write_sessions(out.where("kept"), str(tmp_path / "o"), head)
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["meta", "u", "s3"]
    assert sinks.summary(out.where("kept")).first().summary == "[User (turn 0)]:\ndo it\n\n---\n\n[Assistant (turn 2)]:\ntail"
    assert tiers(turns, 20).where("tier = 'long'").count() == 1


def test_archived_numbers(spark):
    assert 148 / 1283 == pytest.approx(0.1154, abs=1e-4)
    rows = [("summary", 2435, 0.02, 0), ("summary", 2435, 0.02, 1), ("eitf", 39698, 0.06, 2), ("eitf", 59705, 0.05, 3)]
    frame = spark.createDataFrame(rows, "method string, kept_tokens long, y double, ord long")
    assert R.first_of(frame, ["method", "kept_tokens"], "ord").count() == 3
    assert {r.ord for r in R.pareto(frame, "kept_tokens", "y", "ord").collect()} == {0, 2}


def test_streaming_watcher_agrees_with_batch(spark, tmp_path):
    from winnow.streaming.watcher import watch

    rows = [("s", 1, 100, "x"), ("s", 2, 40, "compacted"), ("s", 3, 10, "x"), ("s", 4, 2, "compacted"), ("t", 1, 9, "x"), ("t", 2, 4, "x")]
    frame = spark.createDataFrame(rows, "session string, seq long, n_lines long, last_type string")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    q = watch(stream).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.session, r.seq) for r in spark.sql("select * from seen").collect()}
    assert got == {(r.session, r.seq) for r in events(frame).collect()} == {("s", 2), ("s", 3)}
