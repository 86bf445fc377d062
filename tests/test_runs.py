import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark import render
from tidemark.config import load
from tidemark.functions.text import stop_words
from tidemark.operators import classify, gates, themes
from tidemark.plans import report_run
from tidemark.sources import feeds
from tidemark.sources.store import Store
from tidemark.streaming import ingest

NOW = dt.datetime(2026, 10, 1, 18, 0)
TODAY = NOW.date()
RSS = """<rss version="2.0"><channel><title>c</title>{}</channel></rss>"""
ITEM = "<item><title>{}</title><link>{}</link><pubDate>{}</pubDate></item>"


def feed(items):
    return RSS.format("".join(ITEM.format(*i) for i in items)).encode()


def fake(bodies):
    def fetch(url, agent, timeout):
        if isinstance(bodies[url], Exception):
            raise bodies[url]
        return bodies[url]

    return fetch


TITLES = ["Steel prices fall again in Ohio", "Steel prices fall hard in Texas", "Steel prices fall now in Maine", "Banks rally on rate cut", "Chip makers beat estimates", "Oil slips", "Gold jumps", "Garden party tonight", "Airlines add routes"]


def batch(spark, titles=TITLES, source="outlet", hours=2):
    when = lambda k: (NOW - dt.timedelta(hours=hours, minutes=k)).strftime("%a, %d %b %Y %H:%M:%S +0000")
    bodies = {"u": feed([(t, f"https://x.example/{source}/{k}", when(k)) for k, t in enumerate(titles)])}
    return feeds.fetch_all(spark, [(source, "u")], NOW, fake(bodies), lambda s: None)


def test_feeds(spark):
    three = RSS.format(
        "<item><title>Fed &amp;amp; markets</title><link>https://a/1</link><description>d</description><pubDate>Thu, 24 Sep 2026 17:12:04 -0400</pubDate></item>"
        "<item><title>No date</title><link>https://a/2</link></item><item><title>Only title</title></item><item><title>...</title><link>https://a/3</link></item>"
    ).encode()
    rows, status = feeds.fetch_all(spark, [("a", "1"), ("b", "2"), ("c", "3")], NOW, fake({"1": three, "2": ValueError("boom"), "3": RSS.format("").encode()}), lambda s: None)
    got = rows.orderBy("seq").collect()
    assert [(r["title"], r["published_at"], r["summary"]) for r in got] == [("Fed &amp; markets", dt.datetime(2026, 9, 24, 21, 12, 4), "d"), ("No date", None, "")]
    assert got[0]["title_norm"] == "fed markets"
    s = {r["name"]: (r["received"], r["skipped"], r["error"]) for r in status.collect()}
    assert s == {"a": (4, 2, None), "b": (0, 0, "ValueError: boom"), "c": (0, 0, "no entries")}
    assert tuple(feeds.tallies(status).first()) == (1, 3, 4)


def test_jsonl_and_labelled_text(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"sentence": "x", "id": 7}\n\n{"sentence": "y"}\n')
    assert sorted(r["sentence"] for r in feeds.read_jsonl(spark, str(good)).collect()) == ["x", "y"]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"sentence": 3}\n')
    with pytest.raises(Exception, match="bad record"):
        feeds.read_jsonl(spark, str(bad)).collect()
    lines = tmp_path / "c.txt"
    lines.write_bytes("mail a@b.c now @positive\n\ncaf\xe9 @ neutral\n".encode("latin-1"))
    assert sorted(map(tuple, feeds.read_labelled_text(spark, str(lines)).collect())) == [("café", "neutral"), ("mail a@b.c now", "positive")]


def test_store_upsert_keeps_first_and_earliest(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    first, _ = batch(spark, ["Same story!", "Other"], "a")
    assert store.ingest(first) == {"received": 2, "inserted": 2, "duplicates": 0}
    second, _ = batch(spark, ["SAME story", "New one"], "b", hours=5)
    assert store.ingest(second) == {"received": 2, "inserted": 1, "duplicates": 1}
    assert store.ingest(second)["inserted"] == 0
    row = store.headlines().where("title_norm = 'same story'").first()
    assert row["source"] == "a" and row["published_at"] == dt.datetime(2026, 10, 1, 13, 0)
    assert store.unscored().count() == 3
    scores = classify.score_unscored(store.headlines(), classify.rule_classifier)
    assert store.write_scores(scores, NOW) == 3 and store.write_scores(scores, NOW) == 0


def test_daily_run_is_repeatable_and_blocks(spark, tmp_path):
    store, out = Store(spark, str(tmp_path / "s")), str(tmp_path / "out")
    rows, _ = batch(spark)
    path = report_run.run(store, TODAY, NOW, TODAY, classify.rule_classifier, out, rows, [("outlet", True, NOW)])
    first = open(path).read()
    quality = json.loads(open(f"{out}/quality/{TODAY}.json").read())
    limits = {g["name"]: (g["threshold_key"], g["threshold"]) for g in quality["gates"]}
    assert list(limits) == [n for n, *_ in gates.NAMES] and quality["date"] == str(TODAY) and quality["blocked"] is False
    assert limits["stale_feed"] == ("gates.staleness_hours", 36.0) and limits["all_scored"] == (None, None) and limits["thin_day"] == ("explain.min_headlines", 8.0)
    assert "on prices fall, steel, steel prices" in first or "on fall, prices, " in first
    assert "9 headlines from 1 source" in first and "| outlet | 9 |" in first and "100% of headlines from outlet" in first
    assert report_run.run(store, TODAY, NOW, TODAY, classify.rule_classifier, out, rows, [("outlet", True, NOW)]) == path
    assert open(path).read() == first
    with pytest.raises(report_run.Blocked, match="pipeline_fresh"):
        late = NOW + dt.timedelta(hours=40)
        report_run.run(store, late.date(), late, late.date(), classify.rule_classifier, out)


def test_day_of_the_index_zone():
    at = lambda h: dt.datetime(2026, 10, 2, h, 30, tzinfo=dt.timezone.utc)
    assert [report_run.civil_today(at(h)) for h in (3, 4)] == [dt.date(2026, 10, 1), dt.date(2026, 10, 2)]
    assert report_run.civil_today(dt.datetime(2026, 10, 2, 3, 30)) == dt.date(2026, 10, 1)


def test_fixed_vocabulary(spark, tmp_path):
    store, out = Store(spark, str(tmp_path / "s")), str(tmp_path / "out")
    rows, _ = batch(spark)
    kept = str(tmp_path / "v")
    s = load(env={}, explain={"vocabulary": kept})
    with pytest.raises(ValueError, match="no vocabulary at"):
        report_run.run(store, TODAY, NOW, TODAY, classify.rule_classifier, out, rows, None, s)
    known = ["steel", "prices", "fall", "banks"]
    themes.save_vocabulary(spark.createDataFrame([(t, 1, 1.0) for t in known], "term string, df long, idf double"), kept)
    text = open(report_run.run(store, TODAY, NOW, TODAY, classify.rule_classifier, out, rows, None, s)).read()
    words = [w for t in TITLES for w in t.lower().split() if w not in stop_words()]
    n = sum(w not in known for w in words)
    assert f"({n} of {len(words)}) are outside it._" in text and "fit on" not in text


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from tidemark import cli

    listed = tmp_path / "feeds.json"
    listed.write_text(json.dumps({"a": "u", "b": "v"}))
    bodies = {"u": feed([(t, f"https://x.example/{k}", "Thu, 01 Oct 2026 12:00:00 +0000") for k, t in enumerate(TITLES)]), "v": ValueError("down")}
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setattr(feeds, "scan", lambda spark, found, now: feeds.fetch_all(spark, found, now, fake(bodies), lambda s: None))
    store = str(tmp_path / "s")
    assert cli.main(["ingest", "--store", store, "--feeds", str(listed), "--dry-run"]) == 0
    said = capsys.readouterr()
    assert said.out == "a: 9 headlines\n" and "feed b failed: ValueError: down" in said.err and "1/2 feeds live" in said.err
    assert cli.main(["ingest", "--store", store, "--feeds", str(listed)]) == 0 and "9 inserted" in capsys.readouterr().out
    assert cli.main(["score", "--store", store]) == 0 and capsys.readouterr().out == "9 headlines scored\n"
    pred = str(tmp_path / "p")
    spark.createDataFrame([("m", "positive", "positive"), ("m", "neutral", "positive")], "method string, y_true string, y_pred string").write.parquet(pred)
    assert cli.main(["eval", "--pred", pred]) == 0 and "| m | 50.00 % |" in capsys.readouterr().out


def test_empty_report():
    r = render.Report(TODAY, None, None, 0, 0, 0, [], [], [], [], "m@1")
    text = render.markdown(r)
    assert "No headlines for this date." in text and text.endswith("Not financial advice.\n")


def test_escapes_and_regions(tmp_path):
    assert render.text("a|b *c*\n[d]") == "a\\|b \\*c\\* \\[d\\]"
    assert render.url("http://a b<c>|d") == "http://a b\\<c\\>\\|d"
    doc = "x\n<!-- t:start -->\nold\n<!-- t:end -->\ny"
    new = render.replace_region(doc, "t", "new")
    assert new == "x\n<!-- t:start -->\nnew\n<!-- t:end -->\ny" and render.replace_region(new, "t", "new") == new
    with pytest.raises(ValueError):
        render.replace_region("none", "t", "new")


@pytest.mark.parametrize("text", ["2026-10-02", "2026-1-1", "20261001", "2026-02-30"])
def test_bad_dates(text):
    with pytest.raises(ValueError):
        report_run.request(text, TODAY)


def test_stream_replay_changes_nothing(spark, tmp_path):
    store, incoming = Store(spark, str(tmp_path / "s")), str(tmp_path / "in")
    rows, _ = batch(spark)
    rows = rows.withColumns({"label": F.lit(None).cast("string")}).drop("label")
    cols = [c.split()[0] for c in ingest.HEADLINE.split(", ")]
    rows.select(*cols).write.parquet(incoming)
    go = lambda c: ingest.run(spark, incoming, store, str(tmp_path / c), classify.rule_classifier, NOW, TODAY)
    assert [a["inserted"] for a in go("c1")] == [9]
    before = store.daily_index().collect()
    assert go("c1") == []
    assert sum(a["inserted"] for a in go("c2")) == 0
    assert store.daily_index().drop("computed_at").collect() == [r for r in store.daily_index().drop("computed_at").collect()] and len(before) == 1
