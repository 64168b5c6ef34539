"""Near duplicates, lines, vectors, shards, mixing and the pipeline against brute-force versions, and their edge cases."""

import random
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import cluster, graphs, lines, mixing, near, queries, sharding
from lodestone.llm.words import LOWER

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def groups(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text):
    w = (text or "").encode().translate(bytes(LOWER)).split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.fixture(scope="module")
def copies():
    """A group around one text with edits from none to many, small groups, short, empty, null and repeated rows."""
    random.seed(8)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    base, out = [word() for _ in range(80)], []
    for i in range(90):
        w = list(base)
        for _ in range(random.choice([0, 0, 1, 2, 3, 4, 6])):
            w[random.randrange(80)] = word()
        out.append((100 + i, " ".join(w)))
    for i in range(30):
        w = [word() for _ in range(random.randint(1, 60))]
        out += [(300 + 3 * i, " ".join(w)), (301 + 3 * i, " ".join(w[:-1] + [word()])), (302 + 3 * i, " ".join(w).upper())]
    out += [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (5, "A  B"), (6, "a b c"), (7, "long " * 30000), (8, "long " * 30001)]
    random.shuffle(out)
    return out


def test_near_duplicates(spark, copies):
    df = spark.createDataFrame([*copies, (None, "a b")], "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("id", "key", "component_id", "grams")})
    rows = near.near_duplicates(df).collect()
    assert len(rows) == len(copies) + 1
    sets = {i: shingles(t) for i, t in copies}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = groups(ids, links)
    for r in rows:
        if r.doc_id is None:
            assert r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert near.near_duplicates(df.limit(0)).count() == 0


def plain_signature(flat):
    """SuperMinHash element by element, as its definition goes."""
    out = np.full(near.SLOTS, near._NONE, np.int64)
    for e in flat:
        order = list(range(near.SLOTS))
        for j in range(near.SLOTS):
            at, value = near._draw(np.array([e], np.uint64), j)
            k = int(at[0])
            order[j], order[k] = order[k], order[j]
            out[order[j]] = min(out[order[j]], value[0])
    return out


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=6), st.integers(0, 2**30))
def test_signatures_stop_early_without_a_change(sizes, seed):
    flat = np.random.default_rng(seed).integers(0, 2**63, sum(sizes)).astype(np.uint64)
    got, at = near.signatures(flat, np.array(sizes)), 0
    for row, n in zip(got, sizes):
        assert (row == plain_signature(flat[at : at + n])).all()
        at += n


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1400).astype(np.uint64)
    s = near.signatures(np.concatenate([pool[:1200], pool[200:]]), np.array([1200, 1200]))
    assert abs((s[0] == s[1]).mean() - 1000 / 1400) < 0.13


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in cluster.components(spark.createDataFrame(chain, "a bigint, b bigint"), cluster.Scratch(spark)).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[100] == got[101] == got[102] == 100
    assert cluster.components(spark.createDataFrame([], "a bigint, b bigint"), cluster.Scratch(spark)).count() == 0


@pytest.mark.parametrize("levels", [(), ((40, 1),), ((30, 1), (54, 2), (62, 3))])
def test_line_dedup(spark, levels):
    random.seed(len(levels))
    word = lambda: "".join(random.choice("abcdé") for _ in range(4))
    pool = [" ".join(word() for _ in range(random.randint(10, 14))) for _ in range(25)]
    docs = []
    for i in range(60):
        own = []
        for _ in range(random.randint(0, 6)):
            line = list(random.choice(pool).encode("utf-8").decode())
            for _ in range(random.choice([0, 0, 1, 1, 2, 3])):
                p, o = random.randrange(len(line)), random.random()
                line[p : p + 1] = [] if o < 0.3 else [line[p], "x"] if o < 0.6 else ["y"]
            own.append("".join(line) if random.random() < 0.8 else random.choice(["short line", "  ", "}"]))
        docs.append((i, "\n".join(own)))
    docs += [(70, None), (71, ""), (72, "\n\n"), (73, docs[5][1]), (73, docs[5][1]), (74, "z" * 70000), (None, pool[0])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("id", "th", "pos", "line", "_id", "_th", "_gone", "n_lines", "n_removed", "_node", "c0")})
    got = lines.dedup_lines(df, levels=levels).collect()
    assert len(got) == len(docs) and set(df.columns) < set(got[0].asDict())
    edits = lambda n: max([e for low, e in levels if n >= low], default=0)

    def distance(a, b):
        prev = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
            prev = row
        return prev[-1]

    places = {}
    for i, text in dict.fromkeys(docs):
        for k, line in enumerate((text or "").split("\n")):
            if line.strip():
                places.setdefault(line.encode(), []).append((10**9 if i is None else i, k))
    kinds = sorted(places)
    links = [(a, b) for k, a in enumerate(kinds) for b in kinds[:k] if abs(len(a) - len(b)) <= (e := edits(min(len(a), len(b)))) and e and distance(a, b) <= e]
    assert bool(links) == bool(levels)
    root, gone = groups(kinds, links), set()
    for c in set(root.values()):
        gone |= set(sorted(p for k in kinds if root[k] == c for p in places[k])[1:])
    for r in got:
        i = 10**9 if r.doc_id is None else r.doc_id
        text = dict(docs)[r.doc_id]
        kept = [x for k, x in enumerate((text or "").split("\n")) if (i, k) not in gone]
        assert r.text == (None if text is None else "\n".join(kept)), r.doc_id
        assert r.n_removed_ == len((text or "").split("\n")) - len(kept) and r.n_removed == 1 and r._gone == 1
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16))
    for i in range(1, 250):  # a group around the first vector
        x[i] = x[0] + rng.normal(size=16) * 0.22
    x[400:450] = x[399]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.tolist())]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, [float("inf")] * 16), (905, []), (906, [v * 2 for v in rows[0][1]]), (907, rows[300][1][:8]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(1) for c in ("id", "rep", "v", "links")})
    got = {r.vec_id: r for r in graphs.near_vectors(df, shards=3).collect()}
    assert len(got) == len(rows)
    good = {i: np.array(v) for i, v in rows if i is not None and (i < 900 or i == 906)}
    ids = sorted(good)
    u = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    near_ = u @ u.T >= 0.95
    np.fill_diagonal(near_, False)
    want = groups(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near_))])
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.99 * near_.sum() and all(got[i].n_links <= near_[k].sum() for k, i in enumerate(ids))
    assert sum(got[i].component_id != want[i] for i in ids) <= 2
    assert got[0].n_links >= 1 and got[906].component_id == 0
    for i in (900, 901, 902, 903, 904, 905, 907):
        assert got[i].n_links == 0 and got[i].component_id == i and got[i].kept
    assert graphs.near_vectors(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(i, f"text {i}" if i % 7 else None, "en", "big" if i % 3 else f"s{i % 5}", 5) for i in range(1000)] + [(5, "text 5", "en", None, 5), (5, "text 5", "en", None, 5), (None, "", "en", None, 0)]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("id", "place", "shard", "s", "j")})


def test_shards(spark, sources):
    got = sharding.shards(sources).collect()
    n = sources.count()
    assert len(got) == n
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r)
        assert r.text_crc32 == zlib.crc32((f"text {r.doc_id}" if r.size > 1 else "").encode())
    assert set(by) == set(range(16)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    share = sum(r.source == "big" for r in got) / n
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.source == "big" for r in own) - share * len(own)) < 2
    assert sharding.shards(sources.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.integers(1, 60), min_size=1))
def test_pfair_deviates_by_less_than_a_block(shares):
    total, seen = sum(shares.values()), dict.fromkeys(shares, 0)
    order = mixing.period(shares)
    assert len(order) == total
    for t, (s, j) in enumerate(order):
        assert seen[s] == j and j * total // shares[s] <= t < -(-(j + 1) * total // shares[s])
        seen[s] += 1
        assert all(abs(seen[k] - shares[k] * (t + 1) / total) < 1 for k in shares)


def test_mixing(spark, sources):
    weights = {"big": 2.0, "s0": 1.0, "s1": 1.0, "s2": 0.0}
    got = sorted(mixing.mix_sources(sources, weights=weights, block=4).collect(), key=lambda r: r._position)
    assert len(got) == sources.count()
    blocks = {}
    for r in got:
        blocks.setdefault(r._place, set()).add((r.source, r._block))
        assert r._release <= r._place < r._due
    assert all(len(b) == 1 for b in blocks.values()) and sorted(blocks) == list(range(len(blocks)))
    out = mixing.mixed(sources)
    assert out.columns == sources.columns and sorted(map(str, out.collect())) == sorted(map(str, sources.collect()))
    assert mixing.mix_sources(sources.limit(0)).count() == 0


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    order = [[c[0] for c in want.description].index(c) for c in columns]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    assert sorted(str(tuple(r)) for r in got.select(*columns).collect()) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 900000)
    at = docs.union(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cluster.Scratch(spark).save(stage(spark, at, SF))
        assert after.columns == docs.columns, name
        assert after.count() <= at.count() and after.where("doc_id >= 900000").count() == 3
        if name == "near_dedup":
            assert near.near_duplicates(after).where("not kept").count() == 0
        if name == "mixing":
            assert sorted(map(str, after.collect())) == sorted(map(str, at.collect()))
        at = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, at, SF)
    assert pieces.select("doc_id").distinct().count() == at.select("doc_id").distinct().count()
    assert corpus_pipeline.STAGES[1][1](spark, docs.limit(0), SF).count() == 0


def test_pair_test_equals_plain_distances(spark):
    """Random pairs in both orders, most of them near: what is left after trimming may be shorter than the edits allowed."""
    rng, rows = random.Random(1), []
    for _ in range(3000):
        x = [rng.choice("abcd ") for _ in range(rng.choice([2, 5, 20, 40, 64, 100, 128, 300]))]
        y = list(x)
        for _ in range(rng.randrange(0, 6)):
            k, r = rng.randrange(len(y) + 1), rng.random()
            y[k : k + (r > 0.33)] = rng.choice("abcd ") if r < 0.33 or r > 0.66 else ""
        rows += [("".join(x), "".join(y) or "a", rng.choice([1, 2, 3]))] * 1
    rows += [(y, x, e) for x, y, e in rows]
    df = spark.createDataFrame(rows, "x string, y string, e int").withColumns({"bx": F.col("x").cast("binary"), "by": F.col("y").cast("binary")})
    out = df.select("x", "y", "e", F.expr(lines.within_edits("bx", "by", "e", 3)).alias("got"), F.expr("levenshtein(x, y) <= e").alias("want"), F.expr(lines.blocks_stand("bx", "by", "e")).alias("blocks")).collect()
    assert [r for r in out if r.got != r.want] == [] and sum(r.want for r in out) > 1000
    assert all(r.blocks for r in out if r.want and len(r.x) >= lines.BLOCKS)
