"""The feed source, numbered lines, archives and the sequence rules of the lexicon against plain Python."""

import datetime as dt
import hashlib
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.operators import classify
from tidemark.sources import feeds

NOW = dt.datetime(2026, 10, 1, 12)
BODIES = {
    "a": "<rss><channel><item><title>One &amp; two</title><link>https://x/1</link><pubDate>Wed, 30 Sep 2026 10:00:00 GMT</pubDate></item>"
    "<item><title></title><link>https://x/2</link></item></channel></rss>",
    "b": "<rss><channel></channel></rss>",
    "c": "<rss><broken",
    "d": "<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>Atom</title><link href='https://x/3'/><updated>2026-09-30T10:00:00Z</updated></entry></feed>",
}
FETCHER = f"BODIES = {BODIES!r}\ndef fetch(url, agent, timeout):\n    if url == 'down':\n        raise OSError('no route for ' + agent)\n    return BODIES[url].encode()\n"


def rows_of(found, status):
    pick = lambda df, *c: sorted(map(tuple, df.select(*c).collect()), key=repr)
    return pick(found, "source", "title", "url", "published_at", "seq"), pick(status, "name", "received", "skipped", "newest_published_at", "error")


def test_the_feed_source_equals_the_loop_and_fetches_once(spark, tmp_path):
    (tmp_path / "fetcher_of_tests.py").write_text(FETCHER)
    spark.sparkContext.addPyFile(str(tmp_path / "fetcher_of_tests.py"))
    listed = [("first", "a"), ("none", "b"), ("odd", "c"), ("atom", "d"), ("gone", "down")]
    import fetcher_of_tests

    loop = rows_of(*feeds.fetch_all(spark, listed, NOW, fetcher_of_tests.fetch, lambda s: None))
    assert rows_of(*feeds.scan(spark, listed, NOW, "fetcher_of_tests:fetch")) == loop
    assert [(x[0], x[1], x[2], x[4]) for x in loop[1]] == [
        ("atom", 1, 0, None), ("first", 2, 1, None), ("gone", 0, 0, "OSError: no route for tidemark"), ("none", 0, 0, "no entries"), ("odd", 0, 0, loop[1][4][4])]
    rows = spark.read.format("feeds").option("feeds", json.dumps(listed)).option("fetcher", "fetcher_of_tests:fetch").load()
    assert rows.rdd.getNumPartitions() == len(listed)


def test_lines_of_files_of_several_blocks_are_numbered(spark, tmp_path):
    r = random.Random(1)
    texts = {f"f{k}.txt": ["x" * r.randint(0, 300) for _ in range(n)] for k, n in enumerate((5000, 1, 900))}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50k")
    try:
        df = feeds.numbered_lines(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {}
        for x in df.collect():
            got.setdefault(x.file.rsplit("/", 1)[1], []).append((x.line, x.value))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {k: sorted(v) for k, v in got.items()} == {k: list(enumerate(v, 1)) for k, v in texts.items()}


@pytest.mark.parametrize(("bad", "message"), [
    ('{"sentence": "a"', "not valid JSON"), ('{"text": "a"}', 'missing "sentence" field'), ('["a"]', 'missing "sentence" field'), ('{"sentence": 3}', '"sentence" is not a string'),
])
def test_a_bad_record_is_named_by_its_line(spark, tmp_path, bad, message):
    (tmp_path / "in.jsonl").write_text('{"sentence": "ok", "id": 7}\n\n' + bad + '\n{"sentence": 1}\n')
    with pytest.raises(ValueError, match=rf"in\.jsonl:3: {message}"):
        feeds.read_jsonl(spark, str(tmp_path / "in.jsonl"))
    (tmp_path / "in.jsonl").write_text('{"sentence": "ok", "id": 7}\n\n')
    (row,) = feeds.read_jsonl(spark, str(tmp_path / "in.jsonl")).select("sentence", F.to_json("record").alias("r")).collect()
    assert row.sentence == "ok" and json.loads(row.r) == {"sentence": "ok", "id": 7}


def test_archive_members_are_pinned(spark, tmp_path):
    path = tmp_path / "a.zip"
    text = "Profit é rose .@positive\nIt@is@neutral\n\n"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data/All.txt", text.encode("latin-1"))
    pin = hashlib.sha256(path.read_bytes()).hexdigest()
    lines = feeds.archive_lines(spark, str(path), "data/All.txt", pin)
    assert [(x.line, x.value) for x in lines.collect()] == list(enumerate(text.split("\n")[:-1], 1))
    assert sorted(map(tuple, feeds.split_labelled(lines).collect())) == [("It@is", "neutral"), ("Profit é rose .", "positive")]
    for args, message in (((str(path), "data/All.txt", "0" * 64), "has the checksum"), ((str(path), "none.txt", pin), "has no member none.txt")):
        with pytest.raises(Exception, match=message):
            feeds.archive_lines(spark, *args).collect()


LEXICON = {"good": 1.9, "great": 3.1, "bad": -2.5, "fine": 0.8}


def brute_score(text, rules):
    words = re.findall(r"[\w']+", text or "")
    low, loud = [w.lower() for w in words], [w.isupper() for w in words]
    mixed = any(loud) and not all(loud)
    at = low.index(rules.shift) if rules.shift in low else None
    total = 0.0
    for i, w in enumerate(low):
        if w not in LEXICON:
            continue
        v = LEXICON[w]
        if mixed and loud[i]:
            v += 0.733 if v > 0 else -0.733
        for k, fade in enumerate(rules.fade, 1):
            if i - k < 0:
                continue
            p, boost = low[i - k], rules.boosters.get(low[i - k])
            if boost is not None:
                own = -boost if v < 0 else boost
                if mixed and loud[i - k]:
                    own += 0.733 if v > 0 else -0.733
                v += own * fade
            if p in rules.negations:
                v *= rules.negated
        total += v * (1 if at is None or i == at else 0.5 if i < at else 1.5)
    e, a = (text or "").count("!"), (text or "").count("?")
    push = min(e, 4) * 0.292 + (0.96 if a > 3 else a * 0.18 if a > 1 else 0)
    total += push if total > 0 else -push if total < 0 else 0
    return total / (total * total + 15) ** 0.5


def test_rule_scores_equal_a_walk_through_each_sentence(spark):
    r, rules = random.Random(4), classify.Rules()
    pool = ["good", "GREAT", "bad", "fine", "not", "very", "VERY", "slightly", "but", "market", "isn't", "never", "so", "Bad!", "good?", "rates"]
    texts = [" ".join(r.choice(pool) for _ in range(r.randint(0, 12))) + r.choice(["", "!", "!!!!!!", "??", "?????"]) for _ in range(400)] + [None, "", "!!!", "GOOD BAD", "not very good"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({c: F.lit("x") for c in ("w", "v", "s", "at")})
    lexicon = spark.createDataFrame(list(LEXICON.items()), "term string, valence double")
    got = {x.doc_id: x.compound for x in classify.rule_scores(df, lexicon, rules).collect()}
    assert got == pytest.approx({i: brute_score(t, rules) for i, t in enumerate(texts)}, abs=1e-12)
    by = dict(zip(texts, (got[i] for i in range(len(texts)))))
    assert by["not very good"] < 0 == by["!!!"] and got[len(texts) - 5] == 0
    plain = classify.rule_scores(df.limit(0), lexicon, rules)
    assert plain.count() == 0
