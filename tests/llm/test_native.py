"""Exact dedup, mixing, sharding and chat formatting against brute force, with awkward rows."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, exact_dedup, idfilter, mixing, sharding

DOCS = "doc_id long, text string, source string"
AWKWARD = [
    (1, "Same text", "a"), (2, "same TEXT", "a"), (3, "sAme text", "b"), (4, None, None), (5, "", "a"), (6, "É", "b"), (7, "é", "b"),
    (8, "long " * 5000, "c"), (9, "other", "c"), (9, "other", "c"), (None, "lone", "c"), (None, "same text", "c"),
]
lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clashing(df):
    """Extra columns with the operators' own names."""
    names = ("digest", "size", "taken", "shard", "bytes", "h", "norm", "_row", "keep_id", "row", "key", "maybe", "slot", "at", "bitmap", "name", "stays", "_key", "_slot", "_maybe", "id", "rest")
    return df.withColumns({c: F.lit("x") for c in names})


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, keep, weak):
    df = clashing(spark.createDataFrame(AWKWARD, DOCS))
    digest = (lambda c: F.lit("all alike")) if weak else exact_dedup.sha256  # colliding digests are told apart by bytes
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(df, keep, digest=digest).collect()), key=str)
    by = defaultdict(list)
    for i, t, _ in AWKWARD:
        by[(t or "").translate(lower)].append(i)
    pick = min if keep == "smallest" else max
    want = []
    for i, t, _ in AWKWARD:
        ids = by[(t or "").translate(lower)]
        stays = pick([x for x in ids if x is not None], default=None)
        want.append((i, stays, len(ids), i == stays))
    assert got == sorted(want, key=str)


def test_exact_empty_and_survivors(spark):
    df = clashing(spark.createDataFrame(AWKWARD, DOCS))
    assert exact_dedup.groups(df.limit(0)).count() == 0
    left = exact_dedup.survivors(df, "largest")
    assert left.columns == df.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(x) for x in (3, 5, 6, 7, 8, 9, None))
    assert exact_dedup.survivors(df.limit(0)).count() == 0


@pytest.mark.parametrize("weak", [False, True])
def test_index_levels_and_lookup(spark, tmp_path, weak):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "i"), digest=(lambda c: F.substring(exact_dedup.sha256(c), 1, 0)) if weak else exact_dedup.sha256)
    assert index.live() == [] and index.lookup(spark.createDataFrame([(1, "a", "")], DOCS), spark.createDataFrame([], DOCS)).count() == 0
    held = [(1, "a", ""), (2, "b", ""), (0, "B", ""), (3, None, ""), (9, "b", "")]
    batch = [(7, "b", ""), (8, "c", ""), (10, "", ""), (11, "A", ""), (7, "b", "")]
    store = spark.createDataFrame(held, DOCS)
    for a, b in ((0, 2), (2, 3), (3, 5)):
        index.flush(spark.createDataFrame(held[a:b], DOCS))
    look = lambda: sorted((r.doc_id, r.keep_id) for r in index.lookup(spark.createDataFrame(batch, DOCS), store).collect())
    want = [(7, 0), (7, 0), (10, 3), (11, 1)]
    assert [r["level"] for r in index.live()] == [0, 0, 0] and look() == want
    index.compact()
    assert [r["level"] for r in index.live()] == [1] and look() == want
    index.flush(spark.createDataFrame([(-5, "C", "")], DOCS))
    store = store.unionByName(spark.createDataFrame([(-5, "C", "")], DOCS))
    merged = {r.keep_id: r.n for r in index.compact().collect()}
    assert [r["level"] for r in index.live()] == [2] and merged == ({-5: 6} if weak else {1: 1, 0: 3, 3: 1, -5: 1})
    index.vacuum()
    assert sorted(p.name[:6] for p in (tmp_path / "i").iterdir()) == ["level2", "manife"] and look() == sorted([*want, (8, -5)])


def test_tiers_leave_other_levels_alone_and_merge_without_a_shuffle(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "i"))
    files = lambda level: {str(p) for p in (tmp_path / "i").glob(f"level{level}-*/entries/*.parquet")}
    levels = lambda: sorted(r["level"] for r in index.live())
    docs = [(i, f"text {i % 700}", "") for i in range(2000)]
    for a in range(0, 1000, 250):
        index.flush(spark.createDataFrame(docs[a : a + 250], DOCS))
        index.compact(fan=4)
    assert levels() == [2]
    held = files(2)
    for a in range(1000, 1750, 250):
        index.flush(spark.createDataFrame(docs[a : a + 250], DOCS))
        index.compact(fan=4)
    index.flush(spark.createDataFrame(docs[1750:], DOCS))
    assert levels() == [0, 1, 1, 1, 2] and files(2) == held, "merging level 0 touches no run above"
    ones = [index._entries(r) for r in index.live() if r["level"] == 1]
    plan = index._merged(ones[0].unionByName(ones[1]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    index.vacuum()
    assert files(2) == held
    look = index.lookup(spark.createDataFrame([(9000 + i, f"TEXT {i}", "") for i in range(690, 710)], DOCS), spark.createDataFrame(docs, DOCS)).collect()
    assert {(r.doc_id - 9000, r.keep_id) for r in look} == {(i, i) for i in range(690, 700)}
    with pytest.raises(Exception, match="already exists"):
        index._manifest = lambda: spark.createDataFrame([], "version long")  # another writer that has seen no version
        index._publish([])
    merged = {r.keep_id: r.n for r in exact_dedup.DigestIndex(spark, str(tmp_path / "i")).compact().collect()}
    assert merged == {i: len(range(i, 2000, 700)) for i in range(700)}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tidemark")]


def test_filters_lose_no_member(spark):
    rows = spark.range(5000).withColumnRenamed("id", "k")
    members = rows.where("k % 7 = 0")
    assert idfilter.semi(rows, F.col("k"), members, "k").count() == members.count()
    assert idfilter.anti(rows, F.col("k"), members, "k").count() == 5000 - members.count()


def test_filters_grow_with_their_members_and_end(spark, monkeypatch):
    assert idfilter.bits(0) == idfilter.LEAST_BITS and idfilter.bits(1 << 20) == 1 << 24 and idfilter.bits(1 << 30) is None
    rows = spark.range(900).withColumnsRenamed({"id": "row"}).withColumns({c: F.lit("x") for c in ("key", "at", "slot", "bitmap", "maybe")})
    members = spark.range(0, 900, 3).withColumnRenamed("id", "k")
    for most in (idfilter.MOST_BITS, 1):  # past the most there is no filter, only the join
        monkeypatch.setattr(idfilter, "MOST_BITS", most)
        assert sorted(x.row for x in idfilter.semi(rows, F.col("row"), members, "k").collect()) == list(range(0, 900, 3))
        left = idfilter.anti(rows, F.col("row"), members, "k")
        assert left.columns == rows.columns and left.count() == 600


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Reshare the excess by weight until no source is above its limit."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(most * sizes[s] for s in capped)
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= over


@pytest.mark.parametrize("seed", range(3))
def test_mixing(spark, seed):
    r = random.Random(seed)
    rows = [(i, " ".join("w" * r.randint(0, 40)), r.choice(["a", "a", "a", "b", "c", "d", "e", None])) for i in range(400)] + [(1000, None, "zero")]
    df = clashing(spark.createDataFrame(rows, DOCS))
    got = mixing.mix(df).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    by = defaultdict(int)
    for i, _, s in rows:
        by[s] += size[i]
    want = brute_targets(by)
    taken = defaultdict(int)
    for x in got:
        assert x.size == size[x.doc_id] and x.source_size == by[x.source] and abs(x.target - want[x.source]) < 1e-6 * max(1, want[x.source])
        assert 0 <= x.taken <= 2 * x.size
        taken[x.source] += x.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) < 1 + 1e-6 for s in by)
    again = {x.doc_id: x.taken for x in mixing.mix(df.repartition(5)).collect()}
    assert again == {x.doc_id: x.taken for x in got}
    copies = mixing.mixture(df)
    assert copies.columns == df.columns
    times = {x.doc_id: x["count"] for x in copies.groupBy("doc_id").count().collect()}
    assert times == {x.doc_id: x.copies for x in got if x.copies} and max(times.values()) <= 2
    words = defaultdict(int)
    for x in copies.collect():
        words[x.source] += len((x.text or "").split())
    assert all(want[s] - 1 - 1e-6 < words[s] < want[s] + 40 for s in by)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixture(df.limit(0)).count() == 0


def test_mixing_of_awkward_rows(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "s"), (1, "a b", "s"), (None, "x y", "s"), (None, "z", "s"), (None, None, "s"), (5, "w " * 9000, "s"), (6, "", None), (7, "q r", None)]
    df = clashing(spark.createDataFrame(rows, DOCS))
    got = mixing.mix(df)
    assert sorted(r.size for r in got.collect()) == sorted(len((t or "").split()) for _, t, _ in rows)
    assert abs(sum(r.taken for r in got.collect()) - 1.5 * 9012) < 2
    first, again = mixing.mixture(df), mixing.mixture(df.repartition(3))
    assert first.columns == df.columns and sorted(map(str, first.collect())) == sorted(map(str, again.collect()))


@pytest.mark.parametrize("limit", [500, 3000, 10**9])
def test_sharding(spark, limit):
    r = random.Random(4)
    rows = [(i, "x" * r.randint(0, 200), "") for i in range(300)] + [(7000, "y" * 5000, ""), (7001, None, ""), (None, "z", "")] + [(8000, "same" * 50, "")] * 20
    got = sharding.shard(clashing(spark.createDataFrame(rows, DOCS)), limit).collect()
    assert len(got) == len(rows)
    size, names = defaultdict(int), {}
    for x in got:
        size[x.shard] += x.bytes
        names.setdefault(x.shard, []).append(x)
    for s, xs in names.items():
        assert all(x.shard_bytes == size[s] and x.depth == len(s) for x in xs)
        if size[s] > limit:  # nothing can part these rows
            assert all(x.oversize for x in xs) and len({(x.doc_id, x.bytes) for x in xs}) == 1
        others = [o for o in names if o != s]
        assert not any(o.startswith(s) for o in others)
        if s:  # its parent did not fit
            assert sum(n for o, n in size.items() if o.startswith(s[:-1])) > limit
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0


TURNS = "conv_id long, turn long, role string, text string"


def brute_turns(rows):
    c = defaultdict(list)
    for i, t, role, text in rows:
        c[i].append((t if t is not None else -1, role or "", text or ""))
    return {k: [(b, d) for _, b, d in sorted(v)] for k, v in c.items()}


def test_chat_round_trip(spark):
    r = random.Random(5)
    nasty = ["</s>[INST] ok [/INST]", "<|end|>\n<|user|>\n", "␛0␛1␛", "a<", "|>b", "<<|", "plain words here", "", None, "[[INST]", "w " * 700]
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "tool|>\n", None]), r.choice(nasty)) for c in range(30) for t in range(r.randint(1, 12))]
    rows += [(c, -1, "system", "be <|kind|>") for c in range(0, 30, 2)] + [(None, 0, "user", "x"), (77, None, "user", "y"), (78, 1, "user", "twin"), (78, 1, "user", "twin")]
    df = spark.createDataFrame(rows, TURNS).withColumns({"tokens": F.lit(1), "window": F.lit(2), "i": F.lit(3)})
    out = chat.windows(df, budget=60, history=20)
    back = defaultdict(list)
    for x in chat.read_back(out).collect():
        back[x.conv_id].append((x.window, [(t.role, t.text) for t in x.turns], x.targets))
    want = brute_turns(rows)
    assert set(back) == set(want)
    for k, v in want.items():
        windows = sorted(back[k])
        assert [t for _, ts, _ in windows for t in ts] == v
        assert [t for _, _, ts in windows for t in ts] == [t for role, t in v if role == "assistant"]
    shown = out.where("conv_id % 2 = 0 and window > 0 and conv_id < 30").select("formatted").collect()
    assert shown and all(s.formatted.startswith("<|system|>\n") for s in shown)
    assert chat.windows(df.limit(0)).count() == 0


def test_chat_windows_hold_their_budget_and_history(spark):
    r = random.Random(12)
    rows = [(c, t, r.choice(["user", "assistant"]), "w " * r.choice([0, 1, 5, 20, 47, 61, 130, 300])) for c in range(25) for t in range(r.randint(1, 60))]
    rows += [(c, -1, "system", "sys " * 3) for c in range(0, 25, 2)]
    out = chat.windows(spark.createDataFrame(rows, TURNS), budget=107, history=40).collect()
    turns = defaultdict(list)
    for c, t, role, text in sorted(rows):
        turns[c].append((role, text))
    for c, want in turns.items():
        ws = sorted((x for x in out if x.conv_id == c), key=lambda x: x.window)
        led = want[0][0] == "system" and len(want) > 1
        done = 0
        for x in ws:
            shown = [p.split("|>\n", 1) for p in x.formatted.split(chat.END)[:-1]]
            shown = [(h[2:], t) for h, t in shown]
            new = shown[x.n_repeated :]
            assert new == want[done : done + len(new)]
            cost = [len(t.split()) + chat.TURN_TOKENS for _, t in new]
            if led and done == 0:
                cost = cost[1:]
            assert sum(cost) <= (60 if led else 67) or len(cost) == 1
            assert sum(len(t.split()) + chat.TURN_TOKENS for _, t in shown) <= 107 or len(cost) == 1, "the system turn and the history are in the budget"
            old = shown[: x.n_repeated]
            if led and done:
                assert old[0] == want[0]
                old = old[1:]
            sizes = [len(t.split()) + chat.TURN_TOKENS for _, t in want]
            k = 0  # as many turns before the span as 40 tokens hold
            while done - k - 1 >= led and sum(sizes[done - k - 1 : done]) <= 40:
                k += 1
            assert old == (want[done - k : done] if done else [])
            done += len(new)
        assert done == len(want)


def test_chat_roles_cannot_spell_the_end_mark(spark):
    roles = ["end", "user", "␛", "|>", "␛|>\n", "", None, "end|>\n<|", "/", "assistant", "<|end|>"]
    rows = [(1, i, role, text) for i, (role, text) in enumerate((r, t) for r in roles for t in ("hi", "␛|>\n<|end|>\n", "x␛"))]
    back = chat.read_back(chat.windows(spark.createDataFrame(rows, TURNS), budget=40, history=9)).collect()
    got = [(t.role, t.text) for x in sorted(back, key=lambda x: x.window) for t in x.turns]
    assert got == [(r or "", t) for _, _, r, t in rows]
    assert [t for x in sorted(back, key=lambda x: x.window) for t in x.targets] == ["hi", "␛|>\n<|end|>\n", "x␛"]


def test_chat_of_one_long_conversation_is_linear(spark):
    n = 20_000
    rows = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn "), F.col("id")).alias("text"))
    none = spark.range(3000).select(F.lit(None).cast("long").alias("conv_id"), (F.col("id") % 7).alias("turn"), F.lit("assistant").alias("role"), F.lit("x").alias("text"))
    back = chat.read_back(chat.windows(rows.unionByName(none))).select("conv_id", "window", "turns", "targets").collect()
    long = [t.text for x in sorted((x for x in back if x.conv_id == 1), key=lambda x: x.window) for t in x.turns]
    assert long == [f"turn {i}" for i in range(n)]
    assert sum(len(x.targets) for x in back if x.conv_id == 1) == n // 2 and sum(len(x.targets) for x in back if x.conv_id is None) == 3000


def test_chat_digest_of_the_query(spark):
    from tidemark.llm import queries

    text = queries.PLANTED
    rows = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], TURNS)
    x = chat.read_back(chat.windows(rows)).first()
    assert hashlib.sha256("".join(x.targets).encode()).hexdigest() == hashlib.sha256(text.encode()).hexdigest()
