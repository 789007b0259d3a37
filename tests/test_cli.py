"""The commands over a small folder, with a judge behind HTTP."""

import json
import threading
import urllib.error
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from lexigauge import cli
from lexigauge.functions import lint
from lexigauge.sources import logs


class Judge(BaseHTTPRequestHandler):
    """Says A of each pair and 4 of each text; refuses texts with the word refuse."""

    asked = []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["content-length"])))
        prompt = body["messages"][-1]["content"]
        Judge.asked.append(prompt)
        fields = body["response_format"]["json_schema"]["schema"]["properties"]
        said = {k: (4 if v["type"] == "integer" else "A" if k == "verdict" else "because") for k, v in fields.items()}
        answer = {"model": "served", "choices": [{"finish_reason": "length" if "refuse" in prompt else "stop", "message": {"content": json.dumps(said)}}]}
        out = json.dumps(answer).encode()
        self.send_response(200)
        self.send_header("content-length", str(len(out)))
        self.end_headers()
        self.wfile.write(out)

    def log_message(self, *_):
        pass


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    server = HTTPServer(("127.0.0.1", 0), Judge)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = tmp_path_factory.mktemp("bench")
    for name, content in {
        "tasks/a.yaml": "id: a\ncategory: c\ntitle: T\nprompt: P\n",
        "tasks/b.yaml": "id: b\ncategory: c\ntitle: U\nprompt: Q\n",
        "corpus/t.md": "---\ntitle: Text\n---\n設定を行う。",
        "config/models.yaml": f"models:\n- {{id: m, provider: mock, model: x}}\n- {{id: n, provider: mock, model: x, mockStyle: other}}\n- {{id: j, provider: openai, model: y, baseUrl: 'http://127.0.0.1:{server.server_port}/', apiKeyEnv: LEXIGAUGE_TEST_KEY}}\n- {{id: k, provider: openai, model: y, baseUrl: 'http://127.0.0.1:1/', apiKeyEnv: LEXIGAUGE_NO_KEY}}\njudge: {{model: j}}\n",
        "interventions/baseline.yaml": "id: baseline\nname: B\nsteps:\n- type: generate\n",
        "interventions/fix.yaml": "id: fix\nname: F\nsteps:\n- {type: generate, reuse: baseline}\n- {type: textlint-fix}\n",
        "fixtures/mock/plain.md": "=== a ===\n設定を行うことを覚える。\n\n=== b ===\nplease refuse を行う。\n",
    }.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(content, "utf-8")
    yield at
    server.shutdown()


def test_commands(spark, folder, capsys):
    do = lambda *a: cli.main([*a, "--dir", str(folder), "--run", "r"], spark)
    read = lambda name, ddl: logs.read_log(spark, f"{folder}/results/runs/r/{name}.jsonl", ddl).collect()
    do("list")
    assert "intervention\tfix" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        do("report")
    do("run", "--models", "m,n", "--interventions", "baseline,fix")
    samples = {r["id"]: r for r in read("samples", cli.schema.SAMPLES)}
    assert samples["a__m__fix__0"]["text"] == "設定することを覚える。" and samples["a__n__baseline__0"]["text"].startswith("aの見本文") and len(samples) == 8
    do("run", "--models", "m,n", "--interventions", "baseline,fix")
    assert len(read("samples", cli.schema.SAMPLES)) == 8  # nothing is made twice
    do("score")
    assert {r["scoringHash"] for r in read("scores", cli.schema.SCORES)} == {cli.scoring_hash()}
    with pytest.raises(ValueError):
        do("judge", "--baseline", "basline")
    with pytest.raises(RuntimeError):
        do("judge", "--judge", "k")  # no key, no judgments
    do("judge")
    judged = read("judgments", cli.schema.JUDGMENTS)
    rubric = [r for r in judged if r["kind"] == "rubric"]
    assert {r["judgeModel"] for r in judged} == {"j"} and all(r["scores"]["overall"] == 4 and r["rationale"] == "because" for r in rubric)
    assert {r["sampleId"] for r in rubric} == {i for i, s in samples.items() if "refuse" not in s["text"]}
    assert all(r["verdict"] == "tie" for r in judged if r["kind"] == "pairwise")  # A in both orders
    assert "the answer ended with length" in capsys.readouterr().err
    asked = len(Judge.asked)
    assert asked == len(set(Judge.asked))  # equal texts are asked about once
    (folder / "results/runs/r/judgments.jsonl").rename(folder / "results/runs/r/old")
    do("judge", "--limit", "2")
    assert len(read("judgments", cli.schema.JUDGMENTS)) == 2 and len(Judge.asked) == asked  # from the cache
    do("judge", "--mode", "rubric", "--no-cache", "--judge", "m")
    mine = [r for r in read("judgments", cli.schema.JUDGMENTS) if r["judgeModel"] == "m"]
    assert len(mine) == 8 and all(r["rationale"] == "mock" for r in mine)
    do("pairs")
    snapshot = logs.read_snapshot(spark, f"{folder}/results/runs/r/pairs.json", cli.schema.PAIRS).collect()
    assert len(snapshot) == 6  # four of interventions, two of models
    vote = {"pairId": snapshot[0]["id"], "choice": "A", "leftWasA": True, "raterId": "p", "seconds": 2.0}
    (folder / "results/runs/r/votes.jsonl").write_text(json.dumps(vote) + "\n")
    capsys.readouterr()
    do("human-report")
    said = json.loads(capsys.readouterr().out)
    assert said["votes"] == 1 and said["shown"] == 6
    do("report", "--judge", "m")
    assert json.loads((folder / "results/runs/r/report.json").read_text("utf-8"))["judge"] == "m" and "fix" in (folder / "results/runs/r/report.md").read_text("utf-8")
    do("show", "--sample", "a__m__fix__0")
    shown = capsys.readouterr().out
    assert "設定を行うことを覚える。" in shown and "mock" in shown
    do("run", "--corpus", "--models", "m", "--interventions", "baseline")
    assert "t__none__baseline__0" in {r["id"] for r in read("samples", cli.schema.SAMPLES)}


def request(url, body=None):
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body)) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode()


def test_votes_over_http(spark, folder):
    """The page's server deals pairs, takes a vote once, keeps a quota, and refuses what is no vote; votes are in the log."""
    at = folder / "results/runs/r/votes.jsonl"
    at.unlink(missing_ok=True)
    args = cli.parser().parse_args(["serve", "--dir", str(folder), "--run", "r", "--port", "0", "--per-rater", "2"])
    server = cli.Bench(args, spark).vote_server()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    vote = lambda **v: request(f"{base}/api/vote", json.dumps({"choice": "A", "leftWasA": True, "raterId": "r"} | v).encode())[0]
    status, page = request(base + "/")
    assert status == 200 and "どちらが" in page and request(base + "/other")[0] == 404
    dealt = json.loads(request(base + "/api/pairs?rater=r")[1])
    ids = [p["id"] for p in dealt["pairs"]]
    assert dealt["total"] == dealt["remaining"] == 6 and len(ids) == 2
    assert vote(pairId=ids[0], seconds=1.5, comment="ok") == 200 and vote(pairId=ids[0]) == 409
    assert [vote(pairId="none"), vote(pairId=ids[1], choice="C"), vote(pairId=ids[1], raterId="x" * 65), vote(pairId=ids[1], comment="x" * 2001), vote(pairId=ids[1], seconds=-1)] == [404, 400, 400, 400, 400]
    assert request(f"{base}/api/vote", b"x" * 20_000)[0] == 413 and request(f"{base}/api/vote", b"{")[0] == 500
    again = json.loads(request(base + "/api/pairs?rater=r")[1])
    assert again["remaining"] == 5 and len(again["pairs"]) == 1
    other = json.loads(request(base + "/api/pairs?rater=s")[1])["pairs"]
    assert ids[0] not in [p["id"] for p in other]  # what has a vote comes last
    assert vote(pairId=ids[1]) == 200 and vote(pairId=next(p["id"] for p in other if p["id"] not in ids)) == 403
    assert json.loads(request(base + "/api/stats")[1]) == {"pairs": 6, "votes": 2, "raters": 1}
    server.shutdown()
    assert sorted(r["pairId"] for r in logs.read_log(spark, str(at), cli.schema.VOTES).collect()) == sorted(ids)


def test_changed_rules_make_scores_stale(spark, monkeypatch):
    before = cli.scoring_hash()
    monkeypatch.setitem(lint.RULES, "max-ten", ("more than four commas", lint.RULES["max-ten"][1], False))
    assert cli.scoring_hash() != before and cli.scoring_hash("analyser-2") != cli.scoring_hash()
