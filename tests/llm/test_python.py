"""Quality, personal data, HTML, near duplicates, token files and segmentations against brute force."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, components, html_text, lattice, near_dup, pieces, pii, quality, rangecoder, token_files
from tidemark.llm import shingles as S

DOCS = "doc_id long, text string"


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in ("n_words", "fail_bits", "digest", "bands", "rep", "spans", "ids", "start")})


def brute_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    tri = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:])) if tri[x] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_and_policies(spark):
    r = random.Random(0)
    texts = ["".join(r.choice("ab é#\n\t| ") for _ in range(r.randint(0, 60))) for _ in range(200)] + [None, "", "a b c a b c", "x y " * 9000]
    df = clashing(spark.createDataFrame(list(enumerate(texts)), DOCS))
    book = quality.apply_policy(quality.ledger(df))
    rows = {x.doc_id: x for x in book.collect()}
    for i, t in enumerate(texts):
        x = rows[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_measures(t)
        assert x.base_failed == (x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words)
        assert not (x.kept and x.base_failed)
    kept = quality.passing(df)
    assert kept.columns == df.columns and {x.doc_id for x in kept.collect()} == {i for i, x in rows.items() if x.kept}
    bits = [x.fail_bits for x in rows.values()]
    for a in quality.ablation(book).collect():
        bit = 1 << next(q.bit for q in quality.RULES if q.name == a.rule)
        assert (a.n_failed, a.n_only, a.n_kept_without) == (sum(b & bit > 0 for b in bits), sum(b == bit for b in bits), sum(b & ~bit == 0 for b in bits))
    assert quality.ledger(df.limit(0)).count() == 0


def test_passing_goes_by_the_ledgers_bits(spark, monkeypatch):
    df = clashing(spark.createDataFrame([(1, "word " * 60), (2, " ".join(f"w{i}" for i in range(60))), (3, " ".join(f"W{i}A" for i in range(60))), (4, "few"), (5, None)], DOCS))
    used, real = [], quality.failed
    monkeypatch.setattr(quality, "failed", lambda policy, *a, **k: used.append(policy.version) or real(policy, *a, **k))
    for policy in (quality.BASE, quality.V1, quality.Policy("capitals", ("capitals",))):
        used.clear()
        kept = {x.doc_id for x in quality.passing(df, policy).collect()}
        assert used == ["base", policy.version]
        assert kept == {x.doc_id for x in quality.apply_policy(quality.ledger(df), policy).where("kept").collect()}


def brute_pii(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d(m[0])) <= 19 and pii.luhn(d(m[0]))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(d(m[0])) <= 15]


def test_pii_base_equals_patterns():
    r = random.Random(1)
    for _ in range(20000):
        t = "".join(r.choice("12 9.-+@a()Z%_3 é4\n") for _ in range(r.randint(0, 40)))
        assert [s for s in pii.spans(t) if s[0] in pii.BASE] == brute_pii(t)


def test_pii_added_kinds_and_rows(spark):
    t = "See https://user.example.org/a?b=1. IBAN: GB82 WEST 1234 5698 7654 32, token = \"04dbebab91ab85687d33\" and my account is settled."
    assert [(k, t[a:b]) for k, a, b in pii.spans(t)] == [("url", "https://user.example.org/a?b=1"), ("account", "GB82 WEST 1234 5698 7654 32"), ("account", "04dbebab91ab85687d33")]
    assert pii.redact(t, pii.spans(t)).startswith("See [URL]. IBAN: [ACCOUNT], token")
    df = clashing(spark.createDataFrame([(1, None), (2, ""), (None, "a@b.co"), (3, "1.2.3.4 " * 3000), (4, "a@b.co"), (4, "a@b.co")], DOCS))
    got = sorted(((x.doc_id, len(x.spans)) for x in pii.find(df).collect()), key=str)
    assert got == sorted([(1, 0), (2, 0), (None, 1), (3, 3000), (4, 1), (4, 1)], key=str)
    assert pii.find(df.limit(0)).count() == 0


def test_pii_long_identifiers_are_whole():
    for long in ("04dbebab91ab8568" * 8, "x" * 100 + "1234", "-".join(["ab12"] * 40), " ".join(["12ab"] * 40)):
        t = f"secret: {long}, and so on"
        assert [(k, t[a:b]) for k, a, b in pii.spans(t) if k == "account"] == [("account", long)]
        assert pii.redact(t, [s for s in pii.spans(t) if s[0] == "account"]) == "secret: [ACCOUNT], and so on"


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>no";</script></head><body>
<header class="site"><h2>Site name</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>{title}</h1><p>by someone</p></header><p>First {n} <b>bold</b> &amp; caf&eacute;<br>line<p>Second &lt;p&gt; {n}
<div class="x17">Read more on our site</div><div class="ad">Buy</div><form><input value="x"><p>Mail</p></form><ul><li>one {n}<li>two {n}</ul></article>
<section id="comments"><p>Nice!</p></section><aside>Side</aside><footer>&copy; 2026</footer></body></html>"""


def test_html_structure_and_site_template(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(title=f"Title {i}", n=i)) for i in range(12)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://o.example/", "plain < text"), (103, "http://o.example/2", PAGE.format(title="Only", n=1))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "text", "template", "n")})
    got = {x.page_id: x.text for x in html_text.pages_text(df).collect()}
    for i in range(12):
        assert got[i] == f"Title {i}\nFirst {i} bold & café line\nSecond <p> {i}\none {i}\ntwo {i}"
        assert "Read more" not in got[i]  # it recurs on the host's pages
    assert "Read more on our site" in got[103] and (got[100], got[101], got[102]) == ("", "", "plain < text")
    assert html_text.pages_text(df.limit(0)).count() == 0
    copies = spark.createDataFrame([(i, f"http://c.example/{i}", PAGE.format(title="Same", n=1)) for i in range(10)], "page_id long, url string, html string")
    assert {x.text for x in html_text.pages_text(copies).collect()} == {"Same\nFirst 1 bold & café line\nSecond <p> 1\nRead more on our site\none 1\ntwo 1"}


def test_html_template_goes_whatever_its_share(spark):
    legal = "".join(f"<div>Legal notice part {k}: {'all rights are with the owner of this site ' * 3}</div>" for k in range(5))
    page = "<html><body><article><p>{own}</p>{legal}</article></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(own=f"Short story {i}", legal=legal)) for i in range(10)]  # the notice is over nine tenths
    rows += [(10 + i, f"http://h.example/c{i}", page.format(own="Copied story", legal=legal)) for i in range(12)]  # over half of the host's pages
    edits = ["", "", "", "", "", "", "", "<p>Edited.</p>"]  # copies alone, one of them edited, each with an id of its own
    alone = "<html><body><article id='post-{i}'><p>One story that many addresses serve</p><p>Its end</p>{more}</article></body></html>"
    rows += [(30 + i, f"http://c.example/{i}", alone.format(i=i, more=e)) for i, e in enumerate(edits)]
    got = {x.page_id: x.text for x in html_text.pages_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(10)] == [f"Short story {i}" for i in range(10)]
    assert {got[10 + i] for i in range(12)} == {"Copied story"}
    assert [got[30 + i] for i in range(8)] == ["One story that many addresses serve\nIts end" + ("\nEdited." if e else "") for e in edits]


def test_html_keeps_formulas_and_names_that_only_sound_beside():
    page = "<body><article><p>Area is <math><mi>r</mi><annotation>r</annotation></math> squared.</p><div class='share-price'><p>Shares rose.</p></div><section class='related-work'><p>Earlier studies.</p></section>"
    page += "<svg><title>t</title><text>axis</text></svg><div class='post-header'><h1>Head</h1></div><div class='share-buttons'>Share</div><div id='reader-comments-2'>Nice</div><p class='big ad-slot-3'>Buy</p><div class='cookie notice-bar'>C</div>End</article></body>"
    assert html_text.extract(page) == "Area is r squared.\nShares rose.\nEarlier studies.\naxis\nHead\nEnd"


def test_html_template_equals_a_brute_force_count(spark):
    import xml.etree.ElementTree as ET

    r = random.Random(13)

    def block(pool, own, depth=0):
        tag, kids = r.choice(["div", "p", "section"]), ""
        if depth < 2 and tag != "p" and r.random() < 0.5:
            kids = "".join(block(pool, own, depth + 1) for _ in range(r.randint(1, 3)))
        text = r.choice(pool) if r.random() < 0.6 else f"{own} {r.randint(0, 3)}"
        return f"<{tag} class='k{r.randint(0, 1)}'>{text}{kids}</{tag}>"

    pages = []
    for h in range(6):
        pool = [f"host {h} line {k}" for k in range(4)]
        shared = [block(pool, "shared") for _ in range(5)]
        for i in range(r.choice([5, 9, 16, 30])):
            own = f"story {r.randint(0, 2) if h == 5 else i}"
            body = "".join(r.choice(shared) if r.random() < 0.6 else block(pool, own) for _ in range(r.randint(2, 7)))
            pages.append((len(pages), f"http://h{h}.example/{i}", f"<html><body><article>{body}</article></body></html>"))
    blocks_of = lambda x: [t for t in [" ".join((x.text or "").split())] if t] + [t for k in x for t in blocks_of(k) + ([" ".join(k.tail.split())] if (k.tail or "").strip() else [])]
    trees = {i: (u.split("/")[2], ET.fromstring(t).find("body/article")) for i, u, t in pages}
    key = lambda x: ET.tostring(x, encoding="unicode")
    hosts, counts = Counter(h for h, _ in trees.values()), {}
    for i, (h, tree) in trees.items():
        for k in {key(x) for x in tree.iter() if x is not tree}:
            counts.setdefault((h, k), []).append("\n".join(blocks_of(tree)))
    gone = {k for k, texts in counts.items() if len(texts) >= html_text.LEAST and len(texts) >= html_text.SHARE * hosts[k[0]] and len(set(texts)) >= html_text.TEXTS}
    assert gone

    def cut(host, x):
        for k in list(x):
            if (host, key(k)) in gone:
                x.remove(k)
            else:
                cut(host, k)
        return x

    got = {x.page_id: x.text for x in html_text.pages_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == {i: "\n".join(blocks_of(cut(h, tree))) for i, (h, tree) in trees.items()}


def test_html_of_awkward_rows(spark):
    page = "<p>x</p>" + "<p>long text</p>" * 20_000
    df = spark.createDataFrame([(None, "http://a", page), (1, "http://a", "<p>y</p>"), (1, "http://a", "<p>y</p>")], "page_id long, url string, html string")
    got = sorted((str(x.page_id), len(x.text)) for x in html_text.pages_text(df).collect())
    assert got == [("1", 1), ("1", 1), ("None", 1 + 10 * 20_000)]


def test_html_joins_sibling_articles():
    page = "<body><main><article><p>Part one</p><article class='x'><p>inner</p></article></article><div><article><h2>Two</h2><p>Part two is longer than one</p></article></div></main>{}</body>"
    beside = "<article class='comment'><p>Nice</p></article><article class='teaser big'><p>Elsewhere</p></article><div class='teasers'><article><p>Also elsewhere</p></article></div>"
    assert html_text.extract(page.format(beside)) == "Part one\ninner\nTwo\nPart two is longer than one"
    assert html_text.extract("<body><article class='teaser'>a</article><article class='teaser'>longer</article></body>") == "longer"


def test_html_never_fails():
    r = random.Random(2)
    for _ in range(500):
        html_text.extract("".join(r.choice(["<p>", "</p>", "<b", "'", '"', ">", "<!--", "-->", "&amp", "x ", "</article>", "<article>", "<li>", "<script>", "</"]) for _ in range(30)))


def brute_classes(docs, levels):
    w = S.level_weights()
    sets = []
    for _, t in docs:
        c = Counter()
        words = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if x]
        for k in range(max(1, len(words) - 4) if words else 0):
            c[tuple(words[k : k + 5])] += 1
        sets.append(c)
    parent = {i: i for i, _ in docs}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    weight = {}
    for (_, t), c in zip(docs, sets):
        h, _ = S.shingles([(t or "").encode()])
        for x in c:
            hx, _ = S.shingles([" ".join(x).encode()])
            weight[x] = float(w[levels[S.slot(hx)[0]]])
    for a in range(len(docs)):
        for b in range(a):
            x, y = sets[a], sets[b]
            both = sum(weight[k] * min(x[k], y[k]) for k in x.keys() & y.keys())
            every = sum(weight[k] * max(x[k], y[k]) for k in x.keys() | y.keys())
            if (docs[a][1] or "") == (docs[b][1] or "") or every and both / every >= 0.8:
                i, j = top(docs[a][0]), top(docs[b][0])
                parent[max(i, j)] = min(i, j)
    return {i: top(i) for i, _ in docs}


def test_near_duplicates_equal_brute_force(spark):
    r = random.Random(3)
    vocab = [f"w{k}" for k in range(3000)]
    docs = []
    passage = r.choices(vocab, k=90)
    for g in range(12):
        base = r.choices(vocab, k=r.choice([40, 150, 400]))
        for _ in range(r.randint(1, 6)):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = r.choice(vocab)
            docs.append(" ".join(t))
    docs += [" ".join(passage + r.choices(vocab, k=k)) for k in (4, 8, 12, 16, 20, 24, 30, 40, 60, 90)]
    docs += ["a b c", "A  b c", "a b", "", "", None, "w1 " * 3000, "w1 " * 2999, docs[0], docs[0].upper()]
    rows = list(enumerate(docs))
    df = clashing(spark.createDataFrame(rows, DOCS))
    levels, _ = near_dup.idf_table(df.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")))
    got = {x.doc_id: x.class_id for x in near_dup.classes(df).collect()}
    assert got == brute_classes(rows, levels)
    left = near_dup.survivors(df)
    assert left.columns == df.columns and sorted(x.doc_id for x in left.collect()) == sorted(set(got.values()))
    assert near_dup.classes(df.limit(0)).count() == 0
    assert near_dup.classes(spark.createDataFrame([(None, "x y"), (None, None)], DOCS)).count() == 2


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_near_duplicate_recall_on_documents(spark):
    """Every document whose id 100 divides against all documents, pair by pair."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(x.doc_id, (x.text or "").encode()) for x in docs.select("doc_id", "text").collect()]
    levels, _ = near_dup.idf_table(docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")))
    weights, sets = S.level_weights(), {}
    for i, t in rows:
        e, level, _ = S.elements([t], levels)
        order = np.argsort(e)
        sets[i] = e[order], weights[level[order]]
    got = {x.doc_id: x.class_id for x in near_dup.classes(docs).collect()}
    true = [(a, b) for a in sets if a % 100 == 0 for b in sets if a != b and S.similarity(sets[a], sets[b], weights) >= 0.8]
    assert true and sum(got[a] == got[b] for a, b in true) >= 0.9 * len(true)


def test_near_duplicate_tasks_stay_small_in_any_session(spark, monkeypatch):
    """Before, 20 entries a document were broadcast by an estimate that knew nothing of the exploded list, and tasks grew to the session's 64 MB."""
    names = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")
    before, seen = [spark.conf.get(k) for k in names], {}
    real = near_dup.written
    monkeypatch.setattr(near_dup, "written", lambda df, name: seen.update({name: [spark.conf.get(k) for k in names]}) or real(df, name))
    monkeypatch.setattr(near_dup, "TASK_DOCS", 3)
    df = spark.createDataFrame([(i, "some words that all of these texts have in common " * 3 + str(i // 2)) for i in range(40)], DOCS)
    assert near_dup.classes(df).count() == 40
    assert [spark.conf.get(k) for k in names] == before
    assert {tuple(v) for k, v in seen.items() if k != "signed"} == {(str(16 << 20), str(1 << 20), "14")} and "members" in seen and "named" in seen
    with pytest.raises(ZeroDivisionError), common.bounded_tasks(spark, 99):
        1 / 0
    assert [spark.conf.get(k) for k in names] == before


def test_near_duplicates_of_repeated_ids(spark):
    r = random.Random(9)
    a, b, c = ([f"{k}{r.randint(0, 10**6)}" for _ in range(120)] for k in "abc")
    text = lambda words, edit="": " ".join([*words[:60], edit, *words[60:]])
    rows = [(1, text(a)), (1, text(b)), (2, text(a, "x")), (3, text(b, "y")), (3, text(b, "y")), (4, text(c)), (4, text(c)), (None, text(a)), (5, None), (6, "")]
    df = clashing(spark.createDataFrame(rows, DOCS)).withColumns({n: F.lit("x") for n in ("row", "key", "maybe", "_slot", "win", "stays")})
    got = sorted(((x.doc_id, x.class_id) for x in near_dup.classes(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 4), (4, 4), (None, None), (5, 5), (6, 5)], key=str)
    left = near_dup.survivors(df)
    assert left.columns == df.columns
    assert sorted(((x.doc_id, x.text) for x in left.collect()), key=str) == sorted([(1, text(a)), (1, text(b)), (4, text(c)), (None, text(a)), (5, None)], key=str)


def test_consistent_samples_estimate_similarity():
    levels = np.full(S.SLOTS, S.LEVELS - 1, np.uint8)
    base = [f"w{k}" for k in range(500)]
    agree = []
    for k in range(60):
        other = list(base)
        other[100 + k] = "new"
        e, lv, off = S.elements([" ".join(base).encode(), " ".join(other).encode()], levels)
        b = S.bands(e, lv, off)
        agree.append((b[0] == b[1]).mean())
    j = (496 - 5) / (496 + 5)
    assert abs(np.mean(agree) - j**S.ROWS) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 100), (5, 5), (200, 150)]
    got = {x.id: x.class_id for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 150: 150, 200: 150}


@pytest.mark.parametrize("ids", [[], [0], [7] * 5, list(range(65536)), [1, 2, 3, 50000] * 3000, random.Random(4).choices(range(500), k=9000), [0, 65535] * 2000])
def test_range_coder_round_trip(ids):
    assert rangecoder.decode(rangecoder.encode(np.array(ids, np.int64))).tolist() == ids


def adverse(r):
    """Blocks that first teach a context one id and then break it: cycles with single mismatches, runs, swapped guesses."""
    a = r.sample(range(65536), 12)
    out = []
    for _ in range(r.randint(1, 30)):
        kind = r.randint(0, 4)
        if kind == 0:  # two contexts that share their last id
            cycle = [a[0], a[1], a[2], a[3], a[1], a[4]]
            out += cycle * r.randint(1, 40)
            out[-r.randint(1, len(cycle))] = r.choice(a)
        elif kind == 1:
            out += [r.choice(a)] * r.randint(1, 90)
        elif kind == 2:
            out += r.sample(a, 6) * r.randint(1, 9)
        elif kind == 3:
            out += r.choices(range(65536), k=r.randint(1, 30))
        else:  # what order 1 predicts where order 2 was always right
            out += [a[5], a[6], a[7]] * 60 + [a[8], a[6], a[9]] * 3 + [a[5], a[6], a[9]]
    return out[: r.randint(1, rangecoder.BLOCK)]


def test_range_coder_survives_adverse_blocks(monkeypatch):
    monkeypatch.setattr(rangecoder, "SMALL", 1)
    r = random.Random(8)
    blocks = 0
    for block in [16, 300, 1200]:  # all lanes at once, so that each segment holds many generated blocks
        monkeypatch.setattr(rangecoder, "BLOCK", block)
        for _ in range(7):
            ids = []
            for _ in range(500):
                x = adverse(r)
                ids += (x * (block // len(x) + 1))[:block]
                blocks += 1
            monkeypatch.setattr(rangecoder, "LANES", 500)
            assert rangecoder.decode(rangecoder.encode(np.array(ids))).tolist() == ids
    assert blocks > 10000


def test_range_coder_keeps_intervals_when_guesses_are_trusted():
    p, a, x, q, y = 10, 11, 12, 13, 14
    ids = []
    for k in range(30):
        ids += [p, a, x, q, a, y]
        ids[-1] = 100 + k
    ids += [p, a, x, q, a, y] * 60 + [p, a, y]
    for extra in range(34):
        assert rangecoder.decode(rangecoder.encode(np.array(ids + [extra, a, x]))).tolist() == ids + [extra, a, x]


def test_range_coder_limits_damage_to_its_block_and_learns():
    ids = np.array(random.Random(5).choices(range(3000), k=6000))
    whole = rangecoder.encode(ids)
    s = bytearray(whole)
    s[-500] ^= 1  # in the last of six blocks
    good, bad = rangecoder.decode_blocks(bytes(s))
    assert bad == [(5120, 6000)] and (good[:5120] == ids[:5120]).all()
    first = bytearray(whole)
    first[18 + 6 * 16 + 40] ^= 255  # in the first block's list of ids
    good, bad = rangecoder.decode_blocks(bytes(first))
    assert bad == [(0, 1024)] and (good[1024:] == ids[1024:]).all()
    with pytest.raises(rangecoder.Damaged, match="ids 5120 to 6000"):
        rangecoder.decode(bytes(s))
    for cut in (whole[:10], whole[:40], b"XXXX" + whole[4:], whole[:20] + b"z" + whole[21:]):
        with pytest.raises(rangecoder.Damaged):
            rangecoder.decode(cut)
    assert rangecoder.decode_blocks(whole[:-2000])[1]
    assert len(rangecoder.encode(np.tile(ids[:200], 100))) < 0.3 * 2 * 20000


def test_encoder_cuts_new_words_as_the_tokenizer_and_merges_a_piece_once():
    import pyarrow as pa

    e, r = token_files.Encoder(), random.Random(12)
    seen = []
    merges = e.merges
    e.merges = type("Counting", (), {"encode_batch_fast": lambda _, texts, **k: seen.extend(" ".join(texts).split(" ")) or merges.encode_batch_fast(texts, **k)})()
    alphabet = ["a", "Thé", "ß", "don't", "'ll", "'x", "'", "_", "7", "²¼", "ª", "µ", "×", "\u00ad", "\n", "\n\n", "\x01", "\x85", "\xa0", "\x1f", "\u0301", "漢", "Ω", "ɏ", "$$", ".", "<|endoftext|>", " ", " ", " ", " "]
    texts = ["".join(r.choices(alphabet, k=r.randint(0, 25))) for _ in range(4000)] + ["", " ", "x tree, tree. tree! (tree) tree\nfell"]
    for part in (texts[:2000], texts[2000:], texts):
        ids, sizes = e.encode(pa.array(part, pa.string()))
        whole = [[*e.t.encode(x, add_special_tokens=False).ids, token_files.END_ID] for x in part]
        assert sizes.tolist() == [len(x) for x in whole] and ids.tolist() == [i for x in whole for i in x]
    assert seen.count("Ġtree") == 1 and len(seen) == len(set(seen))
    often = e.store.often(10**6)
    assert 0 < len(often.codes) < len(e.store.codes)
    assert all(often.get(np.array([i])).tolist() == e.t.encode(x, add_special_tokens=False).ids for x, i in often.codes.items())


def test_token_files(spark, tmp_path):
    r = random.Random(6)
    parts = ["a", "b'", "s ", "  ", " ", "\n", "é", "1", "!!", " the", "\t", "don't", "漢"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(300)] + [None, "", "word " * 20000, "x <|endoftext|> y", "a<|endoftext|>", " <|endoftext|> b c"]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    df = clashing(spark.createDataFrame(rows, DOCS).repartition(5))
    got = {x.doc_id: (x.start, x.n_tokens, x.ids_crc32) for x in token_files.round_trip(df, str(tmp_path / "f")).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_files.tokenizer_path())
    assert t.encode("x <|endoftext|> y", add_special_tokens=False).ids == [87, 220, 50256, 331]
    start = 0
    for i, text in enumerate(texts):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    whole = {x.doc_id: x.ids for x in token_files.ids(spark, str(tmp_path / "f")).collect()}
    assert whole[300] == [0] and len(whole) == len(texts)
    assert token_files.round_trip(df.limit(0), str(tmp_path / "e")).count() == 0
    twice = spark.createDataFrame([(5, "b"), (5, "b"), (None, "a"), (5, "c"), (None, None)], DOCS)
    got = [(x.doc_id, x.start, x.n_tokens) for x in token_files.round_trip(twice, str(tmp_path / "t")).collect()]
    assert sorted(x[1] for x in got) == [0, 1, 3, 5, 7] or sorted(x[1] for x in got) == [0, 2, 3, 5, 7]
    assert [x[0] for x in sorted(got, key=lambda x: x[1])] == [None, None, 5, 5, 5]


def all_segmentations(vocab, text):
    s = lattice.SPACE + text.replace(" ", lattice.SPACE)
    ids = {p: i for i, p in enumerate(vocab.pieces) if i > 258}
    weight = lambda i: -math.log(2 + min(-vocab.scores[i], len(vocab.pieces)))
    out = {}

    def go(at, acc, w):
        if at == len(s):
            out[tuple(acc)] = w
            return
        for n in range(1, lattice.LONGEST + 1):
            p = s[at : at + n]
            if len(p) == n and p in ids:
                go(at + n, acc + [ids[p]], w + weight(ids[p]))
        if s[at] not in ids:
            b = s[at].encode()
            go(at + 1, acc + [3 + x for x in b], w + vocab.byte_weight * len(b))

    go(0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: w - z for k, w in out.items()}


@pytest.mark.parametrize("text", ["the cat", "a\nb é★", "hi 漢", "a  b", "  x   y", "a\n     ", "ab    \n  c"])
def test_samples_are_distinct_exact_and_unbiased(text):
    _, lat = pieces._tools(None, 1.0)
    want, n = all_segmentations(lat.vocab, text), 3000
    found = pieces.sample_texts([text] * n, np.arange(n).astype(np.uint64) * np.uint64(7919), 3)
    first, total = Counter(), []
    for f in found:
        got = [tuple(s["ids"].tolist()) for s in f]
        assert len(set(got)) == len(got) == min(3, len(want))
        assert all(abs(want[g] - s["logp"]) < 1e-3 for g, s in zip(got, f))
        assert all(a["gumbel"] > b["gumbel"] for a, b in zip(f, f[1:]))
        first[got[0]] += 1
        total.append(sum(math.exp(s["logp"]) / s["inclusion"] for s in f))
    for seg, logp in sorted(want.items(), key=lambda x: -x[1])[:3]:
        p = math.exp(logp)
        assert abs(first[seg] / n - p) < 4.5 * math.sqrt(p * (1 - p) / n) + 1e-3
    assert abs(np.mean(total) - 1) < 0.05


def test_the_librarys_own_segmentation_can_be_drawn():
    sp, lat = pieces._tools(None, 1.0)
    r = random.Random(11)
    for _ in range(40):
        t = "".join(r.choice(["a", "the", " ", "  ", "    ", "\n", "é"]) for _ in range(r.randint(1, 7)))
        s = lattice.Sampler(lat, [t], np.zeros(1, np.uint64))
        at = 0
        for i in sp.encode(t):
            if not lat.vocab.bytes[i] or 3 <= i < 259 and at < s.n and lat.piece[s.node[at], 0] == lattice._FALLBACK:
                at = None
                break
            n = len(sp.id_to_piece(i)) if i >= 259 else 1
            assert lat.piece[s.node[at], n - 1] == i and np.isfinite(lat.log[s.node[at], n - 1])
            at += n
        assert at is None or at == s.n


def test_samples_do_not_depend_on_the_texts_before_them():
    text, keys = "a b  xq\nthe internationalisation of words é", np.arange(1, dtype=np.uint64)
    alone = pieces.sample_texts([text], keys, 3)
    _, lattices = pieces._tools(None, 1.0)
    for before in (["x"], ["unbelievably " * 3 + "z" * 40, "qq words of xq"]):
        lattices._clear()
        pieces.sample_texts(before, np.arange(len(before), dtype=np.uint64), 2)
        assert str(pieces.sample_texts([text], keys, 3)) == str(alone)


def test_copies_of_a_row_get_samples_of_their_own(spark):
    df = clashing(spark.createDataFrame([(1, "some words to cut here")] * 3 + [(2, None)] * 2 + [(None, "x y")], DOCS)).withColumn("copy", F.lit("x"))
    got = pieces.sample(df, 2, copies=True).collect()
    assert sorted((str(x.doc_id), x.copy) for x in got) == [("1", 0), ("1", 1), ("1", 2), ("2", 0), ("2", 1), ("None", 0)]
    assert len({str(x.samples) for x in got if x.doc_id == 1}) == 3
    first = {str(x.samples) for x in pieces.sample(df, 2).collect() if x.doc_id == 1}
    assert first == {str(x.samples) for x in got if x.doc_id == 1 and x.copy == 0}


def test_samples_round_trip_and_ignore_partitioning(spark):
    texts = ["", None, "a", "  x  y ", "漢字 é★\n\nz", "日" * 400, "word " * 3000, "x" * 3000]
    df = clashing(spark.createDataFrame(list(enumerate(texts)) + [(None, "b c")], DOCS))
    a = pieces.sample_digests(df, 3).collect()
    assert all(x.round_trip and x.distinct for x in a) and len(a) == 9
    b = {x.doc_id: x.ids_crc32 for x in pieces.sample_digests(df.repartition(4), 3).collect()}
    assert b == {x.doc_id: x.ids_crc32 for x in a}
    got = {x.doc_id: [list(s.ids) for s in x.samples] for x in pieces.sample(df, 2).collect()}
    assert got[0] == [[]] and {len(v) for k, v in got.items() if k in (4, 6)} == {2}
    assert pieces.sample(df.limit(0)).count() == 0
    back = {x.doc_id: x.text for x in pieces.decode(pieces.encode(df)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))


def test_pipeline_against_stages_by_hand(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(7)
    vocab = [f"word{k}" for k in range(2000)]
    texts = [" ".join(r.choices(vocab, k=r.randint(60, 200))) for _ in range(40)]
    texts += [texts[0], texts[0].upper().lower(), texts[1] + " extra", "too short", "*** " * 80, None, " ".join(["same"] * 80)]
    rows = [(i, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = {i: t for i, t, *_ in rows}
    good = {i for i, t in docs.items() if i < 43}
    exact = {max(j for j in good if docs[j].lower() == docs[i].lower()) for i in good}
    near = exact - {42}  # 42 is 1 and two more words
    assert near == set(range(1, 40)) | {41}
    words = {i: len(docs[i].split()) for i in near}
    by = {}
    for i in near:
        by.setdefault(f"src{i % 4}", []).append(i)
    total, names = 1.5 * sum(words.values()), sorted(by)
    size, weight, capped = {s: sum(words[i] for i in by[s]) for s in names}, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, set()
    while True:
        level = (total - sum(2 * size[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
        if not (over := {s for s in names if s not in capped and level * weight[s] > 2 * size[s]}):
            break
        capped |= over
    want = Counter()
    for s in names:
        budget = math.floor(2 * size[s] if s in capped else level * weight[s])
        epochs, rest = divmod(budget, size[s])
        for i in sorted(by[s], key=lambda i: hashlib.md5(f"mix:{i}".encode()).hexdigest()):
            want[i] += epochs + (rest > 0)
            rest -= words[i]
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(x.doc_id for x in found) == +want and {(x.doc_id, x.copy) for x in found} == {(i, k) for i, n in want.items() for k in range(n)}
    kept = {(x.doc_id, x.copy): x for x in found}
    for x in kept.values():
        assert all(pieces.decode_ids(list(s.ids), pieces._tools(None, 1.0)[1].vocab) == docs[x.doc_id] for s in x.samples)
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize(("page", "text"), [
    ("<main><h1>Title</h1><p>Lead</p><article><p>Inside</p></article><p>After</p></main>", "Title\nLead\nInside\nAfter"),
    ("<div class='content'><p>One</p></div><div class=x><p>no</p></div><div id='post'><p>Two</p></div>", "One\nTwo"),
    ("<main><p>A</p></main><nav>n</nav><main><p>B b</p></main>", "A\nB b"),
    ("<article><p>x</p><div class='share'>His share was 5.</div><div class='share'><a>Tweet this page now.</a></div></article>", "x\nHis share was 5."),
    ("<article><p class='banner text'>A headline</p><div class='comments'>I think so too.</div><div class=ad>Buy this car now.</div></article>", "A headline"),
    ("<main><ul><li><a>x</a></li></ul><article><p>Inside</p></article></main>", "Inside"),
    ("<main><p>Lead</p><article class=teaser><p>T</p></article><article><p>Inside</p></article></main><article>out</article>", "Lead\nInside\nout"),
    ("<div class=share>Not in an article, this one.</div><p>y</p>", "y"),
])
def test_main_part_keeps_the_article(page, text):
    assert html_text.extract(page) == text


def test_pages_of_stray_and_deep_tags_are_linear():
    import time

    n = 100_000
    began = time.process_time()
    for page in ("<div>" * n + "text" + "</b>" * n, "<p>" + "<b>" * n + "text" + "<hr>" * n, "<ul>" + "<div>" * n + "<li></li>" * n + "text", "<b>" * n + "<article>" + "text" + "</b>" * n, "<article>" * n + "text"):
        assert html_text.extract(page) == "text"
    assert time.process_time() - began < 60
    assert html_text.extract("<div>" * 600 + "<p>deep" + "</div>" * 600 + "<article>after</article>") == "after"


def test_passing_with_columns_named_like_its_own(spark):
    df = spark.createDataFrame([(1, "word " * 60, 1, {"a": 1}), (None, " ".join(f"w{i}" for i in range(60)), 2, None)] * 2, "doc_id long, text string, _measured_n_words int, m map<string, int>")
    df = df.withColumns({c: F.lit("x") for c in ("n_words", "row", "fail_bits", "_measured_bits")})
    kept = quality.passing(df)
    assert kept.columns == df.columns and [(r.doc_id, r._measured_n_words) for r in kept.collect()] == [(None, 2)] * 2


@pytest.mark.parametrize(("text", "want"), [
    ("Account Number: 12345678", [("account", "12345678")]), ("Passport No. X1234567", [("account", "X1234567")]),
    ("password is hunter22", [("account", "hunter22")]), ("password is correct horse", []), ("the account is open today", []),
    ("see HttpS://ex.org/a(b) and (http://a.b/c).", [("url", "HttpS://ex.org/a(b)"), ("url", "http://a.b/c")]),
    ("http://[::1]:80/y, ftp://münchen.de!", [("url", "http://[::1]:80/y"), ("url", "ftp://münchen.de")]),
    ("http://u:pw@h.de/x", [("email", "pw@h.de"), ("url", "http://u:pw@h.de/x")]), ("http:// and http://! and :// and http://-x", []),
])
def test_added_kinds(text, want):
    assert [(k, text[a:b]) for k, a, b in pii.spans(text)] == want


def test_addresses_are_found_in_linear_time():
    import time

    n, began = 100_000, time.process_time()
    for text in ("http://!" * n, "http://a" * n, "http://a.b" + "." * n * 8, "http://a@" * n, "password is " * n):
        pii.spans(text)
    assert time.process_time() - began < 60
