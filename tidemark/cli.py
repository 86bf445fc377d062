"""Command line: ingest, report, score, eval, splits and queries."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession


def session() -> SparkSession:
    return SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("report", help="run a day: exit code 1 if a gate blocks, 2 for a bad request")
    r.add_argument("--store", required=True)
    r.add_argument("--out", default="reports")
    r.add_argument("--date")
    r.add_argument("--batch", help="Parquet headlines to ingest first")
    r.add_argument("--feeds", help="JSON file of feed names and addresses to fetch first")
    i = sub.add_parser("ingest", help="fetch feeds into the store")
    i.add_argument("--store", required=True)
    i.add_argument("--feeds", required=True)
    i.add_argument("--dry-run", action="store_true", help="print what was fetched and store nothing")
    v = sub.add_parser("eval", help="metrics of predictions (Parquet with y_true, y_pred, method) as a Markdown table")
    v.add_argument("--pred", required=True)
    v.add_argument("--doc", help="document whose region named metrics is replaced")
    s = sub.add_parser("score", help="classify JSON lines, one text or the store's unscored headlines")
    mode = s.add_mutually_exclusive_group(required=True)
    mode.add_argument("--text")
    mode.add_argument("--file")
    mode.add_argument("--store")
    s.add_argument("--benchmark", action="store_true", help="time the classifier on the file instead of printing its labels")
    b = sub.add_parser("splits", help="build splits of Parquet rows (id, text, label), sum them up, or check that files are nested")
    b.add_argument("--path", help="folder of the splits")
    b.add_argument("--build", metavar="ROWS", help="split these rows into the folder and keep a sample beside them")
    b.add_argument("--summary", action="store_true", help="labels of each split, after the pin has been checked")
    b.add_argument("--check-nesting", nargs="+", metavar="ROWS", help="files of rows from the smallest to the largest; exit code 1 if a text is missing")
    q = sub.add_parser("query", help="run a registered query and print rows")
    q.add_argument("name")
    q.add_argument("dir")
    q.add_argument("--rows", type=int, default=20)
    a = p.parse_args(argv)
    if a.command == "score" and a.benchmark and not a.file:
        p.error("--benchmark needs --file")
    if a.command == "splits" and not (a.check_nesting or a.path and (a.build or a.summary)):
        p.error("splits needs --check-nesting, or --path with --build or --summary")
    from tidemark import render
    from tidemark.operators import classify, metrics, splits
    from tidemark.plans import queries, report_run
    from tidemark.sources import feeds
    from tidemark.sources.store import Store

    spark, now = session(), dt.datetime.now(dt.timezone.utc)
    say = lambda text: print(text, file=sys.stderr)

    def fetched():
        """Rows and feed status of the feeds in the file; failures are said, not raised."""
        with open(a.feeds, encoding="utf-8") as f:
            rows, status = feeds.scan(spark, list(json.load(f).items()), now)
        rows, status = rows.cache(), status.collect()
        for x in status:
            if x["error"]:
                say(f"warning: feed {x['name']} failed: {x['error']}")
        say(f"ingest: {sum(x['error'] is None for x in status)}/{len(status)} feeds live, {sum(x['received'] for x in status)} entries")
        return rows, [(x["name"], x["error"] is None, x["newest_published_at"]) for x in status]

    if a.command == "report":
        today = report_run.civil_today(now)
        try:
            day = report_run.request(a.date, today)
        except ValueError as e:
            say(e)
            return 2
        try:
            batch, seen = fetched() if a.feeds else (spark.read.parquet(a.batch) if a.batch else None, None)
            print(report_run.run(Store(spark, a.store), day, now, today, classify.rule_classifier, a.out, batch, seen))
        except report_run.Blocked as e:
            say(e)
            return 1
    elif a.command == "ingest":
        rows, _ = fetched()
        if a.dry_run:
            for x in rows.groupBy("source").count().orderBy("source").collect():
                print(f"{x['source']}: {x['count']} headlines")
        else:
            done = Store(spark, a.store).ingest(rows)
            print(", ".join(f"{n} {name}" for name, n in done.items()))
    elif a.command == "eval":
        found = metrics.overall(metrics.require_rows(spark.read.parquet(a.pred)), "method").orderBy("method").collect()
        table = render.metrics_table([x.asDict() for x in found])
        if a.doc:
            with open(a.doc, encoding="utf-8") as f:
                render.write_atomic(a.doc, render.replace_region(f.read(), "metrics", table))
        else:
            print(table, end="")
    elif a.command == "score" and a.store:
        store = Store(spark, a.store)
        n = store.write_scores(classify.score_unscored(store.headlines(), classify.rule_classifier), now.replace(tzinfo=None))
        print(f"{n} headlines scored")
    elif a.command == "score":
        try:
            rows = spark.createDataFrame([(a.text,)], "sentence string") if a.text is not None else feeds.read_jsonl(spark, a.file)
        except ValueError as e:
            say(e)
            return 2
        if a.benchmark:
            print(json.dumps(classify.speed(classify.timed(rows, classify.rule_classifier, "sentence")).first().asDict()))
            return 0
        for row in classify.score_records(rows.select("sentence"), classify.rule_classifier).toLocalIterator():
            print(json.dumps(row.asDict(), ensure_ascii=False))
    elif a.command == "splits":
        kind = "id long, text string, label string"
        if a.check_nesting:
            bad = splits.nested([(path, spark.read.parquet(path)) for path in a.check_nesting]).take(20)
            for x in bad:
                say(f"{x['outer']} lacks a text of {x['inner']}: {x['value'][:80]}")
            return int(bool(bad))
        if a.build:
            splits.build(spark.read.schema(kind).parquet(a.build), a.path)
        for x in splits.summary(splits.load(spark, a.path, kind)).orderBy("split", "label").collect():
            print(f"{x['split']:<6} {x['label']:<10} {x['n']:>8} {100 * x['share']:5.1f}%")
    else:
        queries.QUERIES[a.name](spark, a.dir).show(a.rows, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
