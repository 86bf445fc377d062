"""Commands for splits and timing, and their refusals."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import classify


@pytest.fixture
def run(spark, monkeypatch, capsys):
    monkeypatch.setattr(cli, "session", lambda: spark)

    def call(*args):
        code = cli.main(list(args))
        said = capsys.readouterr()
        return code, said.out, said.err

    return call


def test_splits_are_built_summed_up_and_checked(spark, tmp_path, run):
    rows = spark.range(200).select("id", F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 4 == 0, "negative").otherwise("neutral").alias("label"))
    rows.write.parquet(str(tmp_path / "rows"))
    code, out, _ = run("splits", "--path", str(tmp_path / "s"), "--build", str(tmp_path / "rows"))
    assert code == 0 and out.splitlines()[0].split() == ["test", "negative", "8", "25.8%"] and len(out.splitlines()) == 6
    assert run("splits", "--path", str(tmp_path / "s"), "--summary")[1] == out
    assert sum(1 for f in (tmp_path / "s/sample").glob("*.json") for _ in f.open()) == 31, "a sample of the test split, which has fewer than 100 rows"
    rows.where("id < 9").write.parquet(str(tmp_path / "small"))
    assert run("splits", "--check-nesting", str(tmp_path / "small"), str(tmp_path / "rows"))[0] == 0
    code, _, err = run("splits", "--check-nesting", str(tmp_path / "rows"), str(tmp_path / "small"))
    assert code == 1 and err.count("lacks a text of") == 20


def test_a_file_is_timed_after_one_batch_to_warm_up(spark, tmp_path, run):
    (tmp_path / "in.jsonl").write_text("".join(json.dumps({"sentence": "x" * i}) + "\n" for i in range(70)))
    code, out, _ = run("score", "--file", str(tmp_path / "in.jsonl"), "--benchmark")
    got = json.loads(out)
    assert code == 0 and got["rows"] == 70 and got["batches"] == 3 and 0 < got["p50"] <= got["p95"] <= got["most"] and got["rows_per_second"] > 0
    calls = str(tmp_path / "calls")

    def load():
        def model(texts):
            with open(calls, "a") as f:
                f.write(f"{len(texts)} ")
            return [("neutral", 0.5)] * len(texts)

        return model

    timings = classify.timed(spark.range(33).select(F.lit("t").alias("text")).coalesce(1), load).collect()
    assert [r["rows"] for r in timings] == [32, 1] and open(calls).read().split() == ["32", "32", "1"]


@pytest.mark.parametrize(("args", "message"), [
    (["score", "--text", "a", "--file", "x"], "not allowed with"), (["score", "--text", "a", "--benchmark"], "--benchmark needs --file"),
    (["splits", "--path", "x"], "splits needs"), (["splits", "--build", "x"], "splits needs"),
])
def test_invalid_combinations_are_refused(args, message, capsys):
    with pytest.raises(SystemExit):
        cli.main(args)
    assert message in capsys.readouterr().err


def test_a_bad_file_is_named_by_its_line(tmp_path, run):
    (tmp_path / "in.jsonl").write_text('{"sentence": "ok"}\n{"label": "neutral"}\n')
    code, _, err = run("score", "--file", str(tmp_path / "in.jsonl"))
    assert code == 2 and 'in.jsonl:2: missing "sentence"' in err
