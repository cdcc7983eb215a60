"""Services by a stub, judging, evaluation of several methods, sweeps, replacement of sessions, and the command line."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from winnow.__main__ import main
from winnow.clients import Chat, Embedder, Reranker, unfenced
from winnow.operators import evidence as V
from winnow.operators import results as R
from winnow.plans import compact as P
from winnow.sources import sessions
from winnow.streaming.watcher import Snapshots, answer_compaction



class Stub(BaseHTTPRequestHandler):
    failures = 0

    def log_message(self, *args):
        pass

    def _say(self, body, code=200):
        data = json.dumps(body).encode()
        self.send_response(code)
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def do_GET(self):  # noqa: N802
        self._say({"status": "ok"}, 200 if self.path == "/health" else 404)

    def do_POST(self):  # noqa: N802
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        if self.path == "/v1/embeddings":
            rows = [{"index": i, "embedding": [float(len(t)), 3.0 * t.count("file"), 0.0]} for i, t in enumerate(body["input"])]
            self._say({"data": rows[::-1]})
        elif self.path == "/v1/rerank":
            self._say({"results": [{"index": i, "relevance_score": len(t) / 10} for i, t in enumerate(body["documents"]) if "skip" not in t][::-1]})
        elif Stub.failures:
            Stub.failures -= 1
            self._say({}, 503)
        else:
            said = body["messages"][-1]["content"]
            if "<conversation>" in said:
                reply = '```json\n[{"id": "p1", "dimension": "progress", "tier": "factual", "question": "what?", "gold_answer": "this", "evidence_turns": [1, 2]}]\n```'
            elif "Gold answer" in said:
                reply = "no JSON" if "odd" in said else '```\n{"score": 7, "reasoning": "fine"}\n```'
            else:
                reply = f" answer of {body['model']} "
            self._say({"choices": [{"message": {"content": reply}}]})


@pytest.fixture(scope="module")
def server():
    http = HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}"
    http.shutdown()


def turns(spark, n=24):
    rows = [(c, i, "user" if i % 3 == 0 else "system", f"turn {i} of file /srv/app{c}/mod{i % 7}.py raised ValueError in load_mod{i % 5}() " + "word " * (40 * (i % 4)), 0) for c in (1, 2) for i in range(n)]
    frame = spark.createDataFrame(rows, "conv_id long, turn_index long, kind string, text string, tokens long")
    return frame.withColumn("tokens", F.ceil(F.length("text") / 4))


def test_clients(server):
    embed, rerank = Embedder(server, batch=2), Reranker(server)
    embed.check()
    rerank.check()
    assert embed(["ab", "a file", "abcd"]) == [pytest.approx(v) for v in ([1, 0, 0], [6 / 45**0.5, 3 / 45**0.5, 0], [1, 0, 0])]
    assert rerank("q", ["abc", "skip", "abcde"]) == {0: 0.3, 2: 0.5}
    with pytest.raises(OSError):
        Embedder(server + "/no").check()
    Stub.failures = 2
    assert Chat(server + "/chat", tries=3, wait=0.01)("m", "", "hello") == "answer of m"
    Stub.failures = 2
    with pytest.raises(OSError):
        Chat(server + "/chat", tries=2, wait=0.01)("m", "", "hello")
    Stub.failures = 0
    assert [unfenced(x) for x in ('```json\n{"a": 1}\n```', " [1] ", "```\n[2]")] == ['{"a": 1}', "[1]", "[2]"]


def test_probes_answers_and_judgements(spark, server):
    chat = Chat(server + "/chat", tries=1)
    shown = V.transcript(turns(spark, 4), 200)
    assert all(r.transcript.startswith("--- Turn 0 (user) ---\nturn 0") and "[...truncated at 200 chars, " in r.transcript for r in shown.collect())
    probes = V.write_probes(V.transcript(turns(spark, 4)), chat, "Write probes.", "writer")
    assert {(r.conv_id, r.probe_id, tuple(r.evidence_turns), r.difficulty) for r in probes.collect()} == {(c, "p1", (1, 2), "medium") for c in (1, 2)}
    contexts = spark.createDataFrame([(c, m, 100, "held") for c in (1, 2) for m in ("eitf", "dedup")], "conv_id long, method string, budget int, context string")
    answers = V.answer(probes, contexts, {"capable": ("big", "Big"), "cheap": ("small", "Small")}, chat, "Answer.")
    assert sorted({(r.model_key, r.answer) for r in answers.collect()}) == [("capable", "answer of big"), ("cheap", "answer of small")] and answers.count() == 8
    odd = answers.limit(1).withColumns({"question": F.lit(None).cast("string")}).unionByName(answers.limit(1).withColumn("question", F.lit("odd")))
    scored = V.judge(answers.unionByName(odd), chat, "Judge.", "judge")
    assert sorted((r.score, r.judge_reasoning.split(":")[0]) for r in scored.collect()) == [(0, "Judge error"), (0, "Probe not found")] + [(3, "fine")] * 8
    total = V.judge_aggregate(scored.where("score = 3"))
    assert {(r.method, r.model_key, r.n_answers, round(r.composite, 6), r.ndcg) for r in total.collect()} == {(m, k, 2, 0.25, 1.0) for m in ("eitf", "dedup") for k in ("capable", "cheap")}
    assert {(r.method, r.gap, r.insight) for r in V.model_gap(total).collect()} == {("eitf", 0.0, "similar"), ("dedup", 0.0, "similar")}
    trace = json.loads(V.traces(scored, "Answer.", "Judge.").where("method = 'eitf'").first().trace)
    assert trace["probe_count"] == 2 and trace["answer_count"] == len(trace["entries"]) and "Gold answer: this" in trace["entries"][0]["judge_user_prompt"]


def test_evaluate_all(spark, server, tmp_path):
    options = {"http-embed": {"embed": Embedder(server)}, "http-rerank": {"rerank": Reranker(server)}}
    found = P.evaluate(turns(spark), "all", str(tmp_path / "w"), options, budget=900, threshold=50)
    assert set(found.selected) == {"dedup", "eitf", "setcover", "http-embed", "http-rerank"} and "needs the option 'embed'" in found.errors["embed"]
    rows = found.entities().collect()
    assert len(rows) == 10 and all(0 <= r.coverage <= 1 and r.speed_s > 0 and r.kept_tokens <= r.total_tokens for r in rows)
    report = found.report().collect()
    assert [r.weight for r in report[:2]] == sorted((r.weight for r in report[:2]), reverse=True) and {"file_path", "f1"} <= {r.metric for r in report}
    probes = spark.createDataFrame([(1, 0, "progress", "easy", [1, 4]), (2, 0, "progress", "hard", [2])], "conv_id long, probe_ord long, dimension string, difficulty string, evidence_turns array<long>")
    assert found.evidence(probes).count() == 10
    out = {r.conv_id: json.loads(r.value) for r in found.export(probes).collect()}
    assert {e["method"] for e in out[1]} == set(found.selected) and all("ndcg" in e and "file_path" in e["type_coverage"] for e in out[2])
    assert all(0 <= r.recall <= 1 and 0 <= r.f1 <= 1 for r in found.recall().collect())
    with pytest.raises(ValueError, match="no method gave a result"):
        P.evaluate(turns(spark), "embed", str(tmp_path / "v"))


def test_sweep_runs_once(spark, tmp_path):
    rows = P.sweep(turns(spark), ["eitf", "embed", "dedup"], [700, 900], str(tmp_path), threshold=50).collect()
    assert {(r.method, r.budget) for r in rows} == {(m, b) for m in ("eitf", "dedup") for b in (700, 900)} and len(rows) == 8
    again = P.sweep(turns(spark).limit(0), ["eitf", "dedup"], [700, 900], str(tmp_path), threshold=50).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_merge(spark):
    schema = "method string, budget int, model_key string, model_label string, composite double, recall double, speed_s double, kept_tokens long, total_tokens long, ord long"
    judged = spark.createDataFrame([("a", 8000, "capable", "A", 0.5, None, 2.0, 10, 20, 0), ("bad", 8000, "capable", "A", 0.1, None, 2.0, 10, 20, 1)], schema)
    early = spark.createDataFrame([("a", 3000, "cheap", "B", 0.4, None, None, None, None, 0), ("bad", 3000, "cheap", "B", 0.3, None, None, None, None, 1)], schema)
    recalls = spark.createDataFrame([("a", 2000, None, None, None, 0.9, 0.7, 1, 2, 0), ("a", 2000, None, None, None, 0.9, 0.8, 1, 2, 1), ("a", 20000, None, None, None, 0.6, 0.5, 3, 4, 2)], schema)
    got = sorted((r.method, r.budget, r.composite, r.recall, r.speed_s, r.kept_tokens) for r in R.merge(judged, early, recalls, "bad").collect())
    assert got == sorted([("a", 8000, 0.5, None, 2.0, 10), ("a", 3000, 0.4, None, 0.8, 7144), ("bad", 3000, 0.3, None, 1.2, 7144), ("a", 20000, None, 0.6, 0.5, 3)])


def test_replacing_sessions(spark, tmp_path):
    path, store = tmp_path / "s.jsonl", tmp_path / "backups"
    path.write_text("old\n")
    session, backups = f"file://{path}", f"file://{store}"
    assert sessions.replace(spark, session, [], backups) is None and path.read_text() == "old\n"
    for i in range(5):
        assert sessions.replace(spark, session, [f"new {i}", "é"], backups)
    assert path.read_text() == "new 4\né\n" and len(list(store.glob("s.jsonl.*.bak"))) == 3
    shots = Snapshots(spark, f"file://{tmp_path}/shots")
    assert answer_compaction(spark, session, shots, lambda p: ["ours"], backups) == "kept: no snapshot"
    path.write_text("the model's own\n")
    assert answer_compaction(spark, session, shots, lambda p: 1 / 0, backups).startswith("kept: division") and path.read_text() == "the model's own\n"
    assert answer_compaction(spark, session, shots, lambda p: [spark.read.text(p).first().value, "ours"], backups) == "replaced"
    assert path.read_text() == "the model's own\nours\n"


def test_command_line(spark, tmp_path, capfd):
    folder = tmp_path / "in"
    folder.mkdir()
    with (folder / "a.jsonl").open("w") as f:
        for i in range(40):
            who = "user" if i % 4 == 0 else "assistant"
            f.write(json.dumps({"type": who, "message": {"role": who, "content": f"step {i} at /srv/app/mod{i % 6}/x.py " + "word " * (30 * (i % 5))}}) + "\n")
    given = [str(folder / "a.jsonl"), "--budget", "600", "--short-threshold", "50"]
    assert main([*given, "--output", str(tmp_path / "out"), "--scores-file", str(tmp_path / "scores")]) == 0
    kept = [x for p in (tmp_path / "out").rglob("*.txt") for x in p.read_text().splitlines()]
    assert 0 < len(kept) < 40 and json.loads(kept[0])["message"]["content"].startswith("step 0")
    assert main(["compact", *given, "--dry-run", "--format", "summary", "--output", str(tmp_path / "sum")]) == 0
    assert main(["evaluate", *given, "--method", "setcover", "--work", str(tmp_path / "work"), "--eval-output", str(tmp_path / "json")]) == 0
    rows = [json.loads(x) for p in (tmp_path / "json").glob("*.txt") for x in p.read_text().splitlines()]
    assert rows[0][0]["method"] == "setcover" and "file_path" in rows[0][0]["type_coverage"]
    (tmp_path / "r.json").write_text(json.dumps(rows[0]))
    assert main(["plot", str(tmp_path / "r.json"), "-o", str(tmp_path / "points")]) == 0
    assert main([]) == 1
    assert "weighted_coverage" in capfd.readouterr().out


def test_rollout_records(spark):
    from winnow.functions.text import rollout_text

    say = lambda kind, **p: json.dumps({"type": kind, "payload": p})
    item = lambda **p: say("response_item", **p)
    cases = [
        (item(type="message", role="user", content=[{"type": "input_text", "text": "hi"}, "bare", {"type": "refusal", "refusal": "no"}, {"type": "image", "text": "x"}]), "hi\nbare\nno"),
        (item(type="message", role="assistant", content="plain"), "plain"),
        (item(type="function_call", name="shell", arguments="a" * 600), "[function_call: shell]\n" + "a" * 500 + "..."),
        (item(type="function_call", name="shell", arguments={"a": 1}), "[function_call: shell]"),
        (item(type="function_call_output", output="b" * 1001), "b" * 1000 + "..."),
        (item(type="function_call_output", output={"a": 1}), None),
        (item(type="reasoning", content=[{"type": "reasoning_text", "text": "think"}, {"type": "text", "text": "x"}], summary=[{"text": "so"}, {"text": ""}, "y"]), "think\nso"),
        (item(type="message", content=[], text="not shown"), None),
        (item(type="other", text="shown"), "shown"),
        (say("compacted", message="short"), "short"),
        (say("turn_context", user_instructions="do", text="x"), "do"),
        (say("turn_context", cwd="/"), None),
        (json.dumps({"type": "response_item", "role": "user"}), None),
        ("no json", None),
    ]
    frame = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, raw string").coalesce(1)
    got = {r.i: r.t for r in frame.select("i", rollout_text("raw").alias("t")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_rollout_sessions(spark, tmp_path):
    line = lambda kind, **p: json.dumps({"type": kind, "payload": p})
    talk = lambda role, text: line("response_item", type="message", role=role, content=[{"type": "input_text", "text": text}])
    path = tmp_path / "r.jsonl"
    path.write_text("\n".join([line("session_meta", id="x"), line("event_msg", message="hidden"), talk("developer", "rules"), line("turn_context", cwd="/"), talk("user", "one"), talk("assistant", "two"), "{broken", line("compacted", message="sum"), talk("user", "three"), talk("assistant", "four")]) + "\n")
    rows = sessions.read_turns(spark, str(path), "rollout").orderBy("turn_index").collect()
    assert [(r.turn_index, r.kind, r.text) for r in rows] == [(0, "system", "rules"), (1, "user", "one"), (2, "system", "two"), (3, "system", "sum"), (4, "user", "three"), (5, "system", "four")]
    path.write_text(line("session_meta", id="x") + "\n")
    assert sessions.read_turns(spark, str(path), "rollout").count() == 0
