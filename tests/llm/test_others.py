"""Chat formatting, URL filters, top-k search and the pipeline."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlark.llm import chat, queries, topk, urls

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def chats_by_hand(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t if t is not None else -math.inf, r or "", x or ""))
    out = {}
    for c, v in by.items():
        v.sort()
        said = "".join(x for _, r, x in v if r == "assistant")
        out[c] = (len(v), sha("".join(f"{r}\n{x}\n" for _, r, x in v)), len(said), sha(said))
    return out


def test_chat_round_trip(spark):
    rnd = random.Random(5)
    bits = ["### ", "</turn>", "\\", "\\0", "\\1", ": ", "\n", "#", "<", "é👍", "user", " ", "assistant", "</tur"]
    text = lambda: None if rnd.random() < 0.05 else "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))
    roles = ["user", "assistant", "assistant", "a: b\\", "", None, "### x"]
    rows = [(c, t, rnd.choice(roles), text()) for c in range(150) for t in range(rnd.randint(1, 9))]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (7, None, "user", "first"), (8, 0, "assistant", "tie"), (8, 0, "assistant", "tie")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    f = chat.format_chats(df)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(f).collect()}
    assert got == chats_by_hand(rows)
    for r in f.collect():
        merged = re.findall(r"### (.*?): ", r.formatted)
        assert all(a != b for a, b in zip(merged, merged[1:]))  # neighbours of one role share a header
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_long_chats(spark):
    rnd = random.Random(15)
    bits = ["### ", "</turn>", "\\", "é👍", "\n", "word ", ": "]
    rows = [(c, t, rnd.choice(["user", "assistant"]), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9)))) for c, n in ((1, 6000), (2, 700), (3, 257), (4, 256)) for t in range(n)]
    rows += [(5, t, "assistant", f"one block {t}") for t in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.format_chats(df)).collect()}
    assert got == chats_by_hand(rows)


def test_chat_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()] + queries.HOSTILE
    df = queries.op9_chat_formatting(spark, sf_dir)
    assert {r.conv_id: tuple(r)[1:5] for r in df.collect()} == chats_by_hand(rows)
    assert not re.search("Python|Pandas|MapInArrow", df._jdf.queryExecution().toString())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name]).to_arrow_table()
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.column_names)
    assert Counter(tuple(r[c] for c in want.column_names) for r in got.collect()) == Counter(tuple(r.values()) for r in want.to_pylist())


def url_by_hand(u):
    at = (u or "").find("://")
    if at < 0:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", u[at + 3 :], re.S)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule_by_hand(host, path):
    best = None
    for v, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, v
    return best or (None, None)


def test_fixed_rules(spark):
    given = [None, "", "no scheme", "http://Example.COM/en/7x?q#f", "https://a.example.com/en/8", "x://com/en/", "http://notcom/en/", "http://b.net/de/8", "http://example.net/de/81", "http://c.example.net/de/7", "ftp://É.org/es/1", "http://org?/es/", "a://b://c.com/en/", "http://x.com#/en/"]
    pages = spark.createDataFrame([(i, u, "clash", "z") for i, u in enumerate(given)] + [(None, "http://q.org/es/", "c", "z")], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in urls.judge(pages, labels).collect():
        u = given[r.page_id] if r.page_id is not None else "http://q.org/es/"
        host, path = url_by_hand(u)
        rule, verdict = rule_by_hand(host, path)
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow"), u
    assert urls.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_block_what_the_labels_say(spark):
    rnd = random.Random(6)
    make = lambda i: f"http://{rnd.choice(['shop', 'blog', 'ads'])}.{rnd.choice(['a', 'b', 'c'])}.info/{rnd.choice(['x', 'y', 'z'])}/{i}?{rnd.choice(['ref', 'id'])}=1"
    data = [(i, make(i)) for i in range(900)]
    bad = lambda u: "//ads." in u and "/x/" in u
    pages = spark.createDataFrame(data, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(not bad(u)), 0) for i, u in data if i % 2 == 0] + [(0, None, None)], "doc_id long, quality int, toxic int")
    out = urls.judge(pages, labels)
    got = {r.page_id: r.verdict == "block" for r in out.collect()}
    assert got == {i: bad(u) for i, u in data}
    noise = spark.createDataFrame([(i, rnd.randint(0, 1), 0) for i, _ in data], "doc_id long, quality int, toxic int")
    assert urls.judge(pages, noise).where("verdict = 'block'").count() == 0


def mined_by_hand(data, least, confidence, longest):
    """Of (items, bad): the kept rules as {(antecedent, verdict): confidence}, by counting every set of tokens."""
    from itertools import combinations

    on = defaultdict(set)
    for i, (items, _) in enumerate(data):
        for t in items:
            on[t].add(i)
    first = {}
    for t in sorted(on):
        first.setdefault(frozenset(on[t]), t)
    mined = {t for t in first.values() if len(on[t]) >= least}  # of tokens that always come together, the first
    have, bads = Counter(), Counter()
    for items, bad in data:
        held = sorted(mined & set(items))
        for k in range(1, min(longest, len(held)) + 1):
            for c in combinations(held, k):
                have[c] += 1
                bads[c] += bad
    rules = {}
    for c, m in have.items():
        for verdict, k in (("block", bads[c]), ("allow", m - bads[c])):
            p, z2 = k / m, urls.Z**2
            low = (p + z2 / (2 * m) - urls.Z * math.sqrt(p * (1 - p) / m + z2 / (4 * m * m))) / (1 + z2 / m)
            if k >= least and low >= confidence:
                rules[c, verdict] = low
    return {(c, v): x for (c, v), x in rules.items() if not any((d, v) in rules and rules[d, v] >= x - 1e-12 for k in range(1, len(c)) for d in combinations(c, k))}


@pytest.mark.parametrize("least,longest,wide", [(None, 4, 12), (75, 4, 12), (None, 2, 12), (None, 3, 2)])
def test_mined_rules_against_brute_force(spark, least, longest, wide):
    rnd = random.Random(8)
    names = [f"h:{c}" for c in "abc"] + [f"p:{c}" for c in "xyz"] + ["q:id", "q:ref"]
    data = []
    for _ in range(1500):
        items = sorted({rnd.choice(names[:3]), rnd.choice(names[3:6]), *rnd.sample(names, 2)})
        low = {"h:a", "p:x"} <= set(items) or "q:ref" in items and "h:b" in items
        data.append((items, rnd.random() < (0.95 if low else 0.1)))
    # a pair that decides, in company that only repeats it, and two tokens that always come together
    data += [([*"mn", f"o{i % 2}", "u", "v"], True) for i in range(80)] + [(["m"], False), (["n"], False)] * 40
    df = spark.createDataFrame(data, "items array<string>, bad boolean").repartition(3)
    got = {(tuple(r.antecedent), r.verdict): r for r in urls.mine(df, least=least, longest=longest, wide=wide).collect()}
    want = mined_by_hand(data, least or urls._least(urls.CONFIDENCE), urls.CONFIDENCE, longest)
    assert set(got) == set(want) and all(abs(got[k].confidence - want[k]) < 1e-9 for k in want) and got
    assert not any("v" in a for a, _ in got)
    pages = Counter(t for items, _ in data for t in items)
    assert all(r.anchor == min(r.antecedent, key=lambda t: (pages[t], t)) for r in got.values())


def test_rules_over_pages_of_many_frequent_tokens(spark):
    """Thirty tokens, each on half of the pages: a rule may be of any of them, the most common ones too."""
    rnd = random.Random(18)
    names = [f"q:{i:02d}" for i in range(30)]
    data = []
    for _ in range(700):
        items = sorted({n for i, n in enumerate(names) if rnd.random() < (0.9 if i < 5 else 0.45)})
        data.append((items, ({"q:00", "q:01", "q:20"} <= set(items)) != (rnd.random() < 0.02)))
    df = spark.createDataFrame(data, "items array<string>, bad boolean").repartition(3)
    got = {(tuple(r.antecedent), r.verdict): r.confidence for r in urls.mine(df, least=60, longest=3).collect()}
    want = mined_by_hand(data, 60, urls.CONFIDENCE, 3)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert (("q:00", "q:01", "q:20"), "block") in got


def test_no_labels_mine_nothing(spark):
    none = spark.createDataFrame([], "items array<string>, bad boolean")
    assert urls.mine(none).count() == 0
    few = spark.createDataFrame([(["a"], True)] * 10 + [([], False)], "items array<string>, bad boolean")
    assert urls.mine(few).count() == 0


def test_long_urls(spark):
    many = "&".join(f"p{c}{d}=1" for c in "abcdefghij" for d in "klmnopqrst")
    data = [(i, f"http://site.info/{'x' if i % 2 else 'y'}/{'seg/' * 3000}?{many}") for i in range(60)]
    pages = spark.createDataFrame(data, "page_id long, url string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in urls.judge(pages, labels).collect()}
    assert got == {i: "allow" if i % 2 else "block" for i in range(60)}


def test_mined_verdicts_of_the_query(spark):
    d = "/root/testdata/sf0.1"
    out = queries.op2_url_filters(spark, d)
    rows = out.collect()
    pages = spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()
    bad = {}
    for r in spark.read.parquet(f"{d}/labels.parquet").collect():
        bad[r.doc_id] = bad.get(r.doc_id, False) or r.toxic == 1 or r.quality == 0
    data = {}
    for r in pages:
        host, path = url_by_hand(r.url)
        query = re.search(r"://[^?#]*\?([^#]*)", r.url)
        named = [f"h:{t}" for t in host.split(".")] + [f"p:{t}" for t in path.split("/")] + [f"q:{t.split('=')[0]}" for t in (query[1].split("&") if query else [])]
        data[r.page_id] = sorted({re.sub("[0-9]+", "0", t) for t in named if len(re.sub("[0-9]+", "0", t)) > 2}), rule_by_hand(host, path)[1]
    known = [(items, verdict == "block") for items, verdict in data.values() if verdict] + [(items, bad[i]) for i, (items, verdict) in data.items() if not verdict and i in bad]
    rules = mined_by_hand(known, urls._least(urls.CONFIDENCE), urls.CONFIDENCE, urls.LONGEST)
    assert rules
    for r in rows:
        items, verdict = data[r.page_id]
        fits = [(round(x, 9), len(a), " ".join(a), v) for (a, v), x in rules.items() if set(a) <= set(items)]
        best = max(fits, default=None)
        if verdict:
            assert (r.verdict, r.mined) == (verdict, None)
        else:
            assert (r.verdict, r.mined) == ((best[3], best[2]) if best else ("allow", None))
    assert any(r.mined for r in rows)


def test_url_query(spark, sf_dir):
    df = queries.op2_url_filters(spark, sf_dir)
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = df.collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.host, r.path) == url_by_hand(pages[r.page_id]) and r.rule == rule_by_hand(r.host, r.path)[0]
    assert not re.search("Python|Pandas|MapInArrow", df._jdf.queryExecution().toString())


def top_by_hand(rows, k=5, every=50):
    v = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = Counter()
    for q in {i for i, _ in v if i % every == 0}:
        own = min(e for i, e in v if i == q)
        best = sorted((-sum(a * b for a, b in zip(own, e)), i) for i, e in v if i != q)[:k]
        out.update((q, r + 1, i, -s) for r, (s, i) in enumerate(best))
    return out


@pytest.mark.parametrize("shard,block", [(16384, 2048), (60, 2)])
def test_top_k_with_ties(spark, shard, block):
    rnd = random.Random(7)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(400)] + [(50, None), (500, [1.0, None, 0.0]), (501, [float("nan"), 0.0, 0.0]), (502, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0])] + [(600, [1.0, 1.0, 1.0])] * 3
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    assert Counter(map(tuple, topk.top_k(df, shard=shard, block=block).collect())) == top_by_hand(rows)
    assert topk.top_k(df.limit(0)).count() == 0
    assert Counter(map(tuple, topk.top_k(df.where("vec_id in (0, 1, 2)")).collect())) == top_by_hand([r for r in rows if r[0] in (0, 1, 2)])


@pytest.mark.parametrize("options", [{}, {"shard": 16, "block": 1}])
@pytest.mark.parametrize("own", [3, 6, 30])
def test_top_k_with_rows_of_the_query_id(spark, own, options):
    rnd = random.Random(own)
    rows = [(50, [2.0, 1.0 + i / 100]) for i in range(own)] + [(i, [rnd.random(), rnd.random()]) for i in range(1, 41)] + [(100, [0.5, 0.5, 0.5])] * 2 + [(101, [0.1, 0.2, 0.3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = top_by_hand(rows[:-3]) + top_by_hand(rows[-3:])
    assert Counter(map(tuple, topk.top_k(df, **options).collect())) == want


def test_top_k_of_one_vector_that_many_share(spark):
    rnd = random.Random(3)
    rows = [(i, [0.25, -0.5, 1.0]) for i in range(700)] + [(i, [rnd.uniform(-1, 1) for _ in range(3)]) for i in range(700, 1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7)
    assert Counter(map(tuple, topk.top_k(df, shard=64, block=4).collect())) == top_by_hand(rows)


def test_tree_bytes_and_splits():
    rng = np.random.default_rng(4)
    points = rng.integers(-50, 50, (3000, 4)).astype(float)
    tree = topk.Tree.from_bytes(topk.Tree(np.arange(3000), points, leaf=40).to_bytes())
    best, ids, _ = tree.search(points[:50], np.full(50, -1), np.full(50, -np.inf), 7)
    for q, s, i in zip(points[:50], best, ids):
        assert [(x, -y) for x, y in zip(s.tolist(), i.tolist())] == sorted(((float(q @ p), -i) for i, p in enumerate(points)), reverse=True)[:7]
    regions = topk.region_of(points, topk.splits(points, 8))
    assert sorted(set(regions.tolist())) == list(range(8)) and np.bincount(regions).max() < 500


def test_top_k_skips_what_cannot_matter(spark):
    """Clustered vectors: a block visits few leaves of its own shard, and few shards."""
    rng = np.random.default_rng(6)
    at = rng.normal(size=(40, 3)) * 5
    rows = [(i, (at[i % 40] + rng.normal(size=3) * 0.05).tolist()) for i in range(12_000)]
    told: list = []
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert Counter(map(tuple, topk.top_k(df, shard=1500, every=400, told=told).collect())) == top_by_hand(rows, every=400)
    leaves, visited = told[0]
    assert visited < leaves / 2


def test_top_k_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert Counter(map(tuple, queries.op7_exact_top_k(spark, sf_dir).collect())) == top_by_hand(rows)


def kept_near(rows):
    """Of (doc_id, text) rows, those that stay when each group of near copies keeps its smallest."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", lower(t or "")) for _, t in rows]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    by, root = defaultdict(list), list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in enumerate(sets):
        shared = Counter(j for x in s for j in by[x] if j < i)
        for j, both in shared.items():
            if rows[i][0] is not None and rows[j][0] is not None and both * 5 >= 4 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)), key=lambda k: rows[k][0])
                root[b] = a
    return [r for i, r in enumerate(rows) if find(i) == i]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_pipeline(spark, sf_dir, tmp_path):
    """run() and each stage against plain loops over rows; odd rows and copies planted among the documents."""
    import shutil

    import corpus_pipeline as p
    from fieldlark.llm import common, secret_scan, toxicity
    from test_tokens import check_packing

    assert [n for n, _ in p.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
    first = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rnd = random.Random(31)
    long = ["".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(200)]
    texts = [" ".join(long), " ".join(long).upper(), " ".join(long[:180]), " ".join(long + ["more"] * 3), " ".join(long[60:]), f"key AKIA{'Q' * 16} and token=abcdefgh", "", None, None]
    planted = [(None if t is None else 900_000 + i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    d = str(tmp_path / "tables")
    first.unionByName(spark.createDataFrame(planted, first.schema)).write.parquet(f"{d}/documents.parquet")
    shutil.copytree(f"{sf_dir}/labels.parquet", f"{d}/labels.parquet") if os.path.isdir(f"{sf_dir}/labels.parquet") else shutil.copy(f"{sf_dir}/labels.parquet", f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")

    of = toxicity.Scorer(toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet"), toxicity.TARGETS))
    rows = [(r.doc_id, r.text) for r in docs.collect() if of(r.text or "")[-1] <= 0.5]
    assert 0.5 * docs.count() < len(rows) < docs.count()
    best = {}
    for i, t in rows:
        best.setdefault(lower(t or ""), []).append((-1 if i is None else i, t))
    rows = [max(v, key=lambda r: r[0]) for v in best.values()]
    rows = [(None if i < 0 else i, t) for i, t in rows]
    near = kept_near(rows)
    assert len(near) < len(rows)
    df = spark.createDataFrame(near, "doc_id long, text string")
    spans = {r.doc_id: [(m.s, m.e) for m in r.spans] for r in secret_scan.scan(df).collect()}
    want = []
    for i, t in near:
        out, at = [], 0
        for s, e in spans[i] if t is not None else []:
            if s >= at:
                out += [t[at:s], "[SECRET]"]
            at = max(at, e)
        want.append((i, None if t is None else "".join(out) + t[at:]))
    assert any("[SECRET]" in (t or "") for _, t in want)

    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = common.stored(stage(spark, docs, d), f"test-{name}")
        assert sorted(docs.dtypes) == sorted(first.dtypes) and docs.count() <= before.count()
    assert Counter((r.doc_id, r.text) for r in docs.collect()) == Counter(want)
    assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text is not None)
    done = p.run(spark, d).collect()
    used, least = check_packing(done, docs.collect(), 4096)
    assert used <= least + 1 and p.ORACLE_SQL is None
