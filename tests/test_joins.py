"""Set join, pivot join, subset scan, stratified folds, bit matrix and committing writes against brute-force versions."""

import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import arms, bits, gram, metrics, neighbours, pivots, setjoin, splits
from lodestone.sources import readers, sinks


def tanimoto_pairs(left, right, limit):
    """All pairs by plain sets."""
    out = []
    for (i, x), (j, y) in itertools.product(left, right):
        x, y = ({b for b in s or [] if b is not None} for s in (x, y))
        if x and y:
            d = round(1 - len(x & y) / len(x | y), 6)
            if d <= limit:
                out.append((i, j, d))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [0.0, 0.35, 0.7])
@pytest.mark.parametrize("hot", [3, 4096])
def test_set_join_against_all_pairs(spark, limit, hot):
    rng = random.Random(int(limit * 10) + hot)
    make = lambda: [rng.randrange(40) for _ in range(rng.randrange(0, 14))] + ([1000] if rng.random() < 0.6 else [])
    left = [(i, make()) for i in range(150)] + [(900, None), (901, []), (902, [None, 5]), (903, [1000]), (904, [7, 7, 1000])]
    right = [(i, make()) for i in range(90)] + [(900, [1000]), (901, [7, 1000]), (3, [5])] + [(i, left[4][1]) for i in range(200, 230)]
    schema = "id int, bits array<int>"
    a, b = spark.createDataFrame(left, schema).withColumn("c", F.lit(1)), spark.createDataFrame(right, schema).withColumn("x", F.lit(1))
    got = setjoin.tanimoto_within(a, b, limit, digits=6, hot=hot)
    assert sorted(((r.pool, r.internal, r.dist) for r in got.collect()), key=str) == tanimoto_pairs(left, right, limit)
    assert setjoin.tanimoto_within(a.where("false"), b, limit).count() == 0


def test_set_join_with_a_bit_in_every_set(spark):
    """Sets that all hold one bit meet by a second one: what is tested grows with the links, not with the square of the rows."""
    rows = [(i, [1, 2] + [100 + 10 * i + k for k in range(8)]) for i in range(600)] + [(5000 + i, [1, 2] + [100 + 10 * i + k for k in range(7)]) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, bits array<int>")
    got = setjoin.tanimoto_within(df, df, 0.4, hot=64).where("pool <> internal").collect()
    assert {(r.pool, r.internal) for r in got} == {p for i in range(50) for p in ((i, 5000 + i), (5000 + i, i))}
    with pytest.raises(ValueError):
        setjoin.tanimoto_within(df, df, 1.0)
    near = setjoin.tanimoto_nearest(setjoin.tanimoto_within(df, df, 0.4), 1).collect()
    assert len(near) == 650 and all(r.dist == 0 for r in near)


def test_set_join_moves_no_set_once_a_pair(spark):
    """Pairs are verified in meetings: what names the links reads no sets, and a set goes to a meeting once."""
    rng = random.Random(3)
    sets = [[1, 2, 3, 4, *rng.sample(range(10, 20), 5)] for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(sets)), "id int, bits array<int>")
    got = setjoin.tanimoto_within(df, df, 0.6)
    assert "array<" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(((r.pool, r.internal, round(r.dist, 6)) for r in got.collect()), key=str) == tanimoto_pairs(list(enumerate(sets)), list(enumerate(sets)), 0.6)


@pytest.mark.parametrize("hash_bytes", [2**26, 2**10])
def test_verified_pairs_in_any_number_of_meetings(spark, tmp_path, hash_bytes):
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(30), rng.randrange(1, 12))) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(sets)), "c bigint, x array<int>")
    pairs = spark.createDataFrame([(i, j) for i in range(80) for j in range(80) if i < j or i % 7 == 0], "a bigint, b bigint")
    got = setjoin.verified_pairs(pairs, df, 0.3, setjoin.telling_seed(df), setjoin.Scratch(spark), hash_bytes).collect()
    both = lambda i, j: (len({*sets[i]} & {*sets[j]}), len({*sets[i]} | {*sets[j]}))
    want = [(i, j, *both(i, j)) for i, j in pairs.collect() if both(i, j)[0] >= 0.3 * both(i, j)[1]]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_values_that_share_a_place_are_told_apart():
    empty = ~np.arange(2**4, dtype=np.int64)
    for one in ([3, 19, 7], [3, 8], [0], [-1, -17]):
        sets = [[3], [19, 35], [3, 19, 7, 0], [-1, 15, 31]]
        sizes = np.array([len(s) for s in sets])
        table = empty.copy()
        k = setjoin._common(np.array(sum(sets, [])), np.cumsum(sizes) - sizes, sizes, np.array(one), table, empty)
        assert k.tolist() == [len({*s} & {*one}) for s in sets] and (table == empty).all()


def test_set_join_of_sets_that_share_words_of_middling_rarity(spark):
    """Sets drawn from few words meet under many of them; only pairs that the bitmaps can't tell apart are rows."""
    rng = random.Random(7)
    sets = [sorted(rng.sample(range(250), 40)) for _ in range(300)]
    sets += [sorted({*s[:36], 900, 901 + i}) for i, s in enumerate(sets[:20])]
    df = spark.createDataFrame([(i, s, True, True) for i, s in enumerate(sets)], "c bigint, x array<int>, left boolean, right boolean")
    met = [(r.a, r.b) for r in setjoin.candidate_pairs(setjoin.with_bitmaps(df, 0.4), 0.4, 100).collect()]
    links = {(i, j) for i, j, _ in tanimoto_pairs(list(enumerate(sets)), list(enumerate(sets)), 0.6) if i != j}
    assert links <= set(met) and len(met) == len(set(met)) < len(sets) ** 2 / 20


def by_distance(x, y, k, same=False):
    d = np.round(1 - x @ y.T / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)), 6) + 0.0
    return {(i, j, r + 1) for i in range(len(x)) for r, j in enumerate(sorted((j for j in range(len(y)) if not (same and i == j)), key=lambda j: (d[i, j], j))[:k])}


def test_pivot_join_against_all_distances(spark, monkeypatch):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    x = centres[rng.integers(0, 12, 600)] + 0.05 * rng.normal(size=(600, 8))
    x[40:90] = x[39]  # many ties
    schema = "id int, v array<double>"
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], schema).repartition(5)
    extra = spark.createDataFrame([(9000, None), (9001, [0.0] * 8), (9002, [float("nan")] * 8), (9003, [float("inf")] * 8)], schema)
    for part, group in ((16_384, 8_192), (50, 40)):
        monkeypatch.setattr(pivots, "PART_ROWS", part)
        monkeypatch.setattr(pivots, "FEW", 0)
        monkeypatch.setattr(pivots, "GROUP_ROWS", group)
        got = pivots.nearest_by_pivots(df.where("id % 7 = 0").union(extra), df.union(extra), 4, digits=6, skip_same=True).collect()
        assert {(r.id, r.other, r["rank"]) for r in got} == {t for t in by_distance(x, x, 4, True) if t[0] % 7 == 0}
    assert np.mean([r.visited for r in got]) < 0.5 * got[0].cells  # clusters are pruned
    y = rng.normal(size=(30, 8))
    few = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], schema)
    got = pivots.nearest_by_pivots(df, few, 50, digits=6).collect()  # fewer than k to find
    assert {(r.id, r.other, r["rank"]) for r in got} == by_distance(x, y, 50)
    assert pivots.nearest_by_pivots(df, few.where("false"), 3).count() == 0 and pivots.nearest_by_pivots(df.where("false"), few, 3).count() == 0


def test_queries_of_the_pivot_join_move_once_a_unit(spark):
    """Where nothing is pruned a query visits all cells, and still moves once as long as the cells fit in one unit."""
    x = np.random.default_rng(5).normal(size=(4500, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    rows = pivots.unit_rows(df, "id", "v")
    at = pivots.choose_pivots(rows)
    cells = pivots.Cells(pivots.in_cells(rows, at), at)
    visits = pivots._visits(rows.where("id < 40").withColumn("bound", F.lit(4.0)), cells, cells.possible).collect()
    assert len(visits) == 40 and {r.visited for r in visits} == {(cells.count > 0).sum()}


def test_pairs_within_hold_few_distances_at_once(spark, monkeypatch):
    """What a task holds is bounded by CELLS, not by the rows that meet; the links are those of one product."""
    x, whole = np.random.default_rng(6).normal(size=(90, 4)), neighbours._distances

    def watched(u, v, metric):
        assert u.shape[0] * v.shape[0] <= 200, "too many distances at once"
        return whole(u, v, metric)

    monkeypatch.setattr(neighbours, "CELLS", 200, raising=False)
    monkeypatch.setattr(neighbours, "_distances", watched)
    want = {(i, j) for i, row in enumerate(whole(x, x, "cosine")) for j in np.nonzero(np.round(row, 6) <= 0.5)[0]}
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"id int, v array<{kind}>")
        assert {(r.pool, r.internal) for r in neighbours.within(df, df, 0.5, digits=6).collect()} == want


@pytest.mark.parametrize("metric", ["cosine", "tanimoto"])
@pytest.mark.parametrize("odd", [1.0, 1e120])
def test_pairs_that_pass_in_single_precision_are_those_of_double(monkeypatch, metric, odd):
    """Ordinary cosines make no whole product in double precision; vectors whose squares overflow or are none do or are near none."""
    x, whole, cells = np.random.default_rng(8).normal(size=(70, 5)), neighbours._distances, []
    x[3], x[4], x[5], x[6] = 0, np.nan, x[7], x[8] * odd
    x[9, 2] = np.inf
    with np.errstate(all="ignore"):
        want = np.round(whole(x, x, metric), 6) + 0.0
    monkeypatch.setattr(neighbours, "_distances", lambda u, v, m: cells.append(len(u) * len(v)) or whole(u, v, m))
    monkeypatch.setattr(neighbours, "CELLS", 200)
    for limit in (0.0, 0.4, 1.0, 2.0):
        with np.errstate(all="ignore"):
            rows, columns, d = neighbours._near(x, x, limit, metric, 6)
        assert {(i, j): k for i, j, k in zip(rows, columns, d, strict=True)} == {(i, j): want[i, j] for i, j in zip(*np.nonzero(want <= limit), strict=True)}
    assert (not cells) == (metric == "cosine" and odd == 1) and max(cells, default=0) <= 200


@pytest.mark.parametrize("kind", ["float", "double"])
def test_links_within_have_each_pair_once(spark, monkeypatch, kind):
    x = np.random.default_rng(9).normal(size=(90, 4)).astype(kind == "float" and np.float32 or np.float64).astype(float)
    rows = [(i % 85, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 4)]  # five ids have two vectors
    df = spark.createDataFrame(rows, f"id bigint, v array<{kind}>")
    near = np.round(neighbours._distances(x, x, "cosine"), 6) <= 0.5
    want = sorted({(min(i % 85, j % 85), max(i % 85, j % 85)) for i, j in zip(*np.nonzero(near), strict=True) if i % 85 != j % 85})
    for least in (7, 1024):
        monkeypatch.setattr(neighbours, "OWN_LEAST", least)
        assert sorted((r.a, r.b) for r in neighbours.links_within(df, 0.5, digits=6).collect()) == want


def ridge(x, y, penalty=1.0):
    m, c = x.mean(0), y.mean()
    w = np.linalg.solve((x - m).T @ (x - m) + penalty * np.eye(x.shape[1]), (x - m).T @ (y - c))
    return lambda z: (z - m) @ w + c


def test_subset_scan_against_fits(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 5)) + 50
    y = x @ [1, -2, 0.5, 0, 3] + rng.normal(size=400) + np.repeat([0, 3, -2, 9], 100)
    origin = np.repeat(["chem:a", "b", "c", "own"], 100)
    fold = np.arange(400) % 3 + 1
    rows = [(str(o), int(f), v.tolist(), float(t)) for o, f, v, t in zip(origin, fold, x, y)] + [("b", 1, None, 1.0), ("c", 1, [1.0] * 5, None), ("c", 2, [1.0] * 4, 2.0), ("c", 2, [float("nan")] * 5, 2.0), (None, 1, [0.0] * 5, 0.0)]
    df = spark.createDataFrame(rows, "origin string, fold int, features array<double>, label double")
    got = {r.mask: r for r in gram.scan(df.where("origin <> 'own' or origin is null"), df.where("origin = 'own'")).collect()}
    names, own = ["b", "c", "chem:a"], origin == "own"
    assert len(got) == 7
    for mask, r in got.items():
        mine = [n for i, n in enumerate(names) if mask >> i & 1]
        train = np.isin(origin, mine)
        assert r.combo == "+".join(n.split(":")[-1] for n in mine) and r.n_train == train.sum()
        p = ridge(x[train], y[train])(x[own])
        e = p - y[own]
        assert r.RMSE == pytest.approx(np.sqrt((e**2).mean())) and r.R2_det == pytest.approx(1 - (e**2).sum() / ((y[own] - y[own].mean()) ** 2).sum()) and r.R2_pears == pytest.approx(np.corrcoef(p, y[own])[0, 1] ** 2)
        e = np.concatenate([ridge(x[train | (own & (fold != f))], y[train | (own & (fold != f))])(x[own & (fold == f)]) - y[own & (fold == f)] for f in (1, 2, 3)])
        assert r.cv_rmse == pytest.approx(np.sqrt((e**2).mean()))
    many = df.withColumn("origin", F.concat(F.lit("o"), F.col("label").cast("string")))
    with pytest.raises(ValueError):
        gram.scan(many, df.where("origin = 'own'"))
    assert gram.scan(df.where("false"), df.where("origin = 'own'")).count() == 0


def test_stratified_folds_are_even(spark):
    rng = random.Random(6)
    rows = [(g, int(rng.random() < 0.27)) for g in range(300) for _ in range(rng.choice([1, 1, 1, 2, 3, 12]))] + [(9000, 1)] * 90 + [(9001, 0)] * 90 + [(None, 0)] * 3 + [(9002, None)] * 4
    df = spark.createDataFrame(rows, "g int, y int")
    out = splits.stratified_group_folds(df, "g", "y").collect()
    assert len(out) == len(rows)
    of = {}
    assert all(of.setdefault(r.g, r.fold) == r.fold for r in out) and set(of.values()) <= set(range(1, 6))
    # Without the two large groups the rest fills up what they leave: sizes and classes stay within one group of even.
    sizes = [sum(r.fold == f for r in out) for f in range(1, 6)]
    ones = [sum(r.fold == f and r.y == 1 for r in out) for f in range(1, 6)]
    assert max(sizes) - min(sizes) <= 90 and max(ones) - min(ones) <= 90
    plain = spark.createDataFrame(rows[:-187], "g int, y int")
    out = splits.stratified_group_folds(plain, "g", "y").collect()
    for share in (lambda r: True, lambda r: r.y == 1):
        n = [sum(r.fold == f and share(r) for r in out) for f in range(1, 6)]
        assert max(n) - min(n) <= 12


def test_stratified_folds_many_equal_groups():
    dealt = splits.deal_patterns([((1, 0), 10**9 + 3), ((0, 1), 7), ((5, 5), 2)], 5)
    assert dealt[(1, 0)][0] == (10**9 + 3) // 5 and len(dealt[(1, 0)][1]) == 3 and dealt[(0, 1)] == (1, dealt[(0, 1)][1])
    assert len(set(dealt[(5, 5)][1])) == 2


def test_bit_matrix_against_sets(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(c, b) for c in range(60) for b in range(30) if rng.random() < 0.15]
    rows += [(c, 100 + b) for c, b in rows if b % 3 == 0] + [(c, 500) for c in range(60)] + rows[:20] + [(None, 1), (3, None)]
    df = spark.createDataFrame(rows, "compound int, bit int")
    compounds = spark.createDataFrame([(c,) for c in range(65)], "compound int")
    on = {}
    for c, b in rows:
        if c is not None and b is not None:
            on.setdefault(b, set()).add(c)
    on = {b: s for b, s in on.items() if len(s) >= 4}
    first = {b: min(x for x in on if on[x] == on[b]) for b in on}
    assert {(r.bit, r.n_compounds, r.kept, r.duplicate_of) for r in bits.keep_bits(df, 4).collect()} == {(b, len(s), first[b] == b, first[b]) for b, s in on.items()}
    matrix, words = bits.bit_matrix(df, compounds, 4)
    column = {r.bit: r.column for r in words.collect()}
    assert sorted(column.values()) == list(range(len(set(first.values())))) and set(column) == set(first.values())
    assert {r.compound: r.indices for r in matrix.collect()} == {c: sorted(column[b] for b in column if c in on[b]) for c in range(65)}


def test_equal_columns_do_not_trust_hashes(spark, monkeypatch):
    """With hashes that say nothing, bits are told apart by their compounds alone."""
    rows = [(c, b) for b, s in {1: "abc", 2: "abd", 3: "abc", 4: "abd", 5: "xyz"}.items() for c in s]
    monkeypatch.setattr(bits.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    got = {r.bit: r.duplicate_of for r in bits.keep_bits(spark.createDataFrame(rows, "compound string, bit int"), 1).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}


def test_rank_correlation_needs_both_values(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, 1.0, None), (None, 3.0, 2.0), (4.0, None, 3.0), (5.0, 6.0, None), (None, 5.0, None), (3.0, None, 9.0), (float("nan"), 4.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    rows_by_pair = {(r["first"], r["second"]): r for r in metrics.rank_association(df, ["a", "b", "c"]).collect()}
    assert rows_by_pair["a", "b"]["n"] == 3 and rows_by_pair["a", "b"]["rho"] == pytest.approx(0.5)
    assert rows_by_pair["a", "c"]["n"] == 3 and rows_by_pair["b", "c"]["n"] == 3
    assert metrics.spearman(df, [], "a", "b").first()["n"] == 3


def test_results_are_whole_or_absent(spark, tmp_path):
    table = str(tmp_path / "results")
    broken = spark.range(9).select(F.raise_error(F.lit("no")).cast("int").alias("x"))
    with pytest.raises(Exception):
        arms.compute_or_load(spark, table, "e", lambda: broken)
    assert not os.path.exists(f"{table}/endpoint=e") and not sinks.committed(spark, f"{table}/endpoint=e")
    os.makedirs(f"{table}/endpoint=e")  # what a run that ended halfway may have left
    calls = []
    compute = lambda: calls.append(1) or spark.range(3).toDF("x")
    assert arms.compute_or_load(spark, table, "e", compute).count() == 3 and arms.compute_or_load(spark, table, "e", compute).count() == 3
    assert len(calls) == 1 and os.listdir(table) == ["endpoint=e"]
    sinks.commit(spark.range(5).toDF("x"), f"{table}/endpoint=e")  # the first to finish stays
    assert spark.read.parquet(f"{table}/endpoint=e").count() == 3


def test_upload_keeps_quotes_and_backslashes(spark, tmp_path):
    file = tmp_path / "u.csv"
    file.write_text('Name,SMILES\n"a ""b""","C/C=C\\C"\nplain,"C\\"\n"x, y",C\\\n')
    got = [(r.compound, r.smiles) for r in readers.read_upload(spark, str(file)).collect()]
    assert got == [('a "b"', "C/C=C\\C"), ("plain", "C\\"), ("x, y", "C\\")]
    file.write_text('id,smiles\n"two\nlines",C\n')
    assert [r.compound for r in readers.read_upload(spark, str(file), multi_line=True).collect()] == ["two\nlines"]
    assert readers.sniff_columns(["x", "canonical_smiles_id", "ID"]) == ("canonical_smiles_id", "canonical_smiles_id")


def test_registry_with_writers_at_once(spark, tmp_path):
    """Threads that add and delete at once: ids and versions come once each and without gaps."""
    from concurrent.futures import ThreadPoolExecutor

    from lodestone.operators import registry

    at = str(tmp_path / "reg")
    registry.Registry(spark, at, create=True)
    base = registry.Registry(spark, at).add("m", "rf", "sol", {}, "a")
    assert base == (1, 1)

    def work(k):
        own = registry.Registry(spark, at)
        new = [own.add("n", "rf", "logd", {"k": k}, f"{k}-{i}") for i in range(5)]
        more = [own.add("m", "rf", "sol", {}, f"{k}-{i}", 1) for i in range(5)]
        return new, more

    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(work, range(4)))
    assert sorted(i for new, _ in done for i, _ in new) == list(range(2, 22)) and all(v == 1 for new, _ in done for _, v in new)
    assert sorted(v for _, more in done for _, v in more) == list(range(2, 22))
    reg = registry.Registry(spark, at)
    assert reg.table().count() == 41 and reg.details(1)["version"] == 21
    reg.delete(21)
    assert reg.add("late", "rf", "hlm", {}, "z")[0] == 22  # a deleted id is not given again
    with pytest.raises(KeyError):
        reg.training_set(1)
    with pytest.raises(ValueError):
        reg.add("m", "rf", "other", {}, "a", 1, training=spark.range(3))
    assert not os.path.exists(f"{at}/_training")


@pytest.fixture
def resource():
    """A paged resource on this machine; it fails every third request once."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    state = {"total": 137, "asked": [], "failed": set()}

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            low, n = int(q["offset"]), int(q["limit"])
            state["asked"].append((low, n))
            if low % 3 == 1 and low not in state["failed"]:
                state["failed"].add(low)
                self.send_error(503)
                return
            items = [{"assay": f"A{i}", "n": i, "kind": q["type"]} for i in range(low, min(low + n, 137))]
            body = json.dumps({"assays": items, "page_meta": {"total_count": state["total"]}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{server.server_port}/assay.json?type=B"
    yield state
    server.shutdown()


def test_paged_resource(spark, tmp_path, resource):
    from lodestone.sources import paged

    options = {"pageSize": 10, "pagesPerPartition": 4, "pause": 0.01}
    rows = paged.paged(spark, resource["url"], "assays", str(tmp_path / "kept"), **options)
    got = paged.documents(rows, "assay string, n bigint, kind string, missing int").orderBy("offset").collect()
    assert [(r.offset, r.assay, r.n, r.kind, r.missing) for r in got] == [(i, f"A{i}", i, "B", None) for i in range(137)]
    assert {low for low, n in resource["asked"] if n > 1} == set(range(0, 137, 10)) and resource["failed"]
    asked = len(resource["asked"])
    assert paged.paged(spark, resource["url"], "assays", str(tmp_path / "kept"), **options).count() == 137 and len(resource["asked"]) == asked
    assert spark.read.format("paged_json").options(url=resource["url"], items="assays", **options).load().rdd.getNumPartitions() == 4
    resource["total"] = 150  # pages come short: an error, and the kept result stays
    with pytest.raises(Exception):
        paged.paged(spark, resource["url"], "assays", str(tmp_path / "new"), **options).count()
    assert not os.path.exists(tmp_path / "new")
    with pytest.raises(Exception):
        paged.paged(spark, resource["url"], "assays", str(tmp_path / "kept"), refresh=True, **options)
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 137


def test_ordered_text_is_whole(spark, tmp_path):
    at = str(tmp_path / "client")
    df = spark.range(500).select(F.col("id"), F.concat(F.lit("c"), "id").alias("name")).repartition(7)
    sinks.write_ordered(df, at, F.concat_ws(",", "name", "id"), [F.col("id").desc()], "compound,id")
    lines = [x for f in sorted(os.listdir(at)) if f.startswith("part-") for x in open(f"{at}/{f}").read().splitlines()]
    assert lines == ["compound,id", *[f"c{i},{i}" for i in range(499, -1, -1)]]
    with pytest.raises(Exception):
        sinks.write_ordered(df, str(tmp_path / "bad"), F.when(F.col("id") < 400, F.col("name")).otherwise(F.raise_error(F.lit("no")).cast("string")), [F.col("id")])
    assert os.listdir(tmp_path) == ["client"]


def test_average_linkage_against_scipy_like_loops():
    from lodestone.operators import grouping

    rng = random.Random(4)
    for _ in range(30):
        names = [f"t{i}" for i in range(9)]
        d = {(a, b): round(rng.random(), 3) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.9}
        clusters, far = [[n] for n in names], lambda x, y: d.get((x, y), d.get((y, x), 1.0))  # noqa: B023
        while len(clusters) > 1:  # from the members' distances each time
            mean = lambda a, b: sum(far(x, y) for x in a for y in b) / (len(a) * len(b))  # noqa: B023
            best, a, b = min(((round(mean(a, b), 12), (a[0], b[0])), a, b) for i, a in enumerate(clusters) for b in clusters[i + 1 :])
            if best[0] > 0.55:
                break
            clusters = sorted([c for c in clusters if c not in (a, b)] + [sorted(a + b)])
        assert grouping.average_linkage(names[::-1], d, 0.55) == clusters
    assert grouping.average_linkage([], {}, 1.0) == [] and grouping.average_linkage(["a", "b"], {}, 0.9) == [["a"], ["b"]]


def test_clusters_choose_the_training_pools(spark):
    from lodestone.operators import grouping

    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    cols = {"hlm": x + 0.2 * rng.normal(size=300), "mlm": -x + 0.2 * rng.normal(size=300), "ppb": rng.normal(size=300), "rare": x}
    rows = [(f"c{i}", "internal" if i % 3 == 0 else "EXP", f"k{i}", *[float(v[i]) if not (n == "rare" and i > 5) and (i + len(n)) % 4 else None for n, v in cols.items()]) for i in range(300)]
    wide = spark.createDataFrame(rows, "smiles string, source string, _ik string, hlm double, mlm double, ppb double, rare double")
    clusters = grouping.task_clusters(wide, list(cols))
    assert clusters == [["hlm", "mlm"], ["ppb"], ["rare"]]  # few rows don't attract, however alike
    tasks, public, internal = grouping.grouped_pools(wide, clusters, "mlm")
    assert tasks == ["hlm", "mlm"] and internal.where("mlm is null").count() == 0
    assert public.where("hlm is null and mlm is null").count() == 0 and public.where("source = 'internal'").count() == 0


def test_folds_say_where_they_come_from(spark):
    df = spark.range(20).withColumnRenamed("id", "compound")
    stored = spark.createDataFrame([(i, i % 3 + 1) for i in range(15)] + [(99, 1)], "compound bigint, fold int")
    rows, source, lost = splits.folds_with_source(df, stored, "compound", "rf/sol")
    assert source == "stored:rf/sol" and lost == 1 and {r.compound: r.fold for r in rows.collect()} == {i: i % 3 + 1 if i < 15 else None for i in range(20)}
    rows, source, lost = splits.folds_with_source(df, None, "compound")
    assert source == "independent" and lost == 0 and {r.fold for r in rows.collect()} == {1, 2, 3, 4, 5}
    with pytest.raises(ValueError):
        splits.folds_with_source(df, df, "compound")
