"""Jobs that were once cut short: each test fails where the cut comes back."""

import random
from collections import Counter
from fractions import Fraction
from math import ceil

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import cluster, counts, graphs, lines, mixing, queries, toxicity


def deviation(order, blocks, weights):
    """The most by which a prefix misses a source's exact share, in blocks, while all sources last."""
    total, seen, worst = sum(weights.values()), dict.fromkeys(blocks, 0), 0.0
    for t, s in enumerate(order, 1):
        seen[s] += 1
        worst = max(worst, *(abs(seen[k] - t * weights[k] / total) for k in blocks))
        if seen[s] == blocks[s]:
            break
    return worst


def test_mixing_holds_the_given_weights():
    hot = {"hot": 5342, **{f"s{i}": 563 for i in range(19)}}
    for blocks, weights in ((hot, {s: n**0.5 for s, n in hot.items()}), ({"a": 16000, "b": 160}, {"a": 1000.0, "b": 1.0})):
        rows = list(mixing.schedule(blocks, weights))
        assert len(rows) == sum(blocks.values())
        assert deviation([r[0] for r in rows], blocks, weights) < 1


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdefgh"), st.tuples(st.integers(1, 60), st.floats(0.001, 1000)), min_size=1))
def test_every_block_keeps_its_window(sources):
    blocks, weights = {s: n for s, (n, _) in sources.items()}, {s: w for s, (_, w) in sources.items()}
    rows, seen = list(mixing.schedule(blocks, weights)), dict.fromkeys(blocks, 0)
    for t, (s, j, release, due) in enumerate(rows):
        assert seen[s] == j and release <= t < due
        seen[s] += 1
    assert seen == blocks and deviation([r[0] for r in rows], blocks, weights) < 1 + 1e-9


def brute_schedule(blocks, weights):
    """Place by place with exact fractions: a fluid that gives sources their weights' shares, and the released block due first."""
    left, done, t, windows = {s: Fraction(n) for s, n in blocks.items()}, dict.fromkeys(blocks, Fraction(0)), Fraction(0), {s: [] for s in blocks}
    while any(left.values()):
        live = {s: Fraction(weights[s]) for s in left if left[s]}
        rate = {s: w / sum(live.values()) for s, w in live.items()}
        step = min(min((done[s] // 1 + 1 - done[s]) / r for s, r in rate.items()), min(left[s] / r for s, r in rate.items()))
        for s, r in rate.items():
            done[s] += r * step
            left[s] -= r * step
            if done[s].denominator == 1:
                windows[s].append(t + step)
        t += step
    ends = {s: [Fraction(0), *w] for s, w in windows.items()}
    made, out = dict.fromkeys(blocks, 0), []
    for place in range(sum(blocks.values())):
        ready = [(ceil(ends[s][made[s] + 1]), s) for s in sorted(blocks) if made[s] < blocks[s] and ends[s][made[s]] // 1 <= place]
        s = min(ready)[1]
        out.append((s, made[s]))
        made[s] += 1
    return out


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.sampled_from("abcde"), st.tuples(st.integers(1, 25), st.integers(1, 97)), min_size=1))
def test_schedule_equals_brute_force(sources):
    blocks, weights = {s: n for s, (n, _) in sources.items()}, {s: w for s, (_, w) in sources.items()}
    assert [(s, j) for s, j, _, _ in mixing.schedule(blocks, weights)] == brute_schedule(blocks, weights)


def test_mixing_holds_given_weights_over_many_blocks():
    weights = {"a": 0.5, "b": 0.4, "c": 0.0985, "d": 0.0015}
    blocks = {s: int(120_000 * w) for s, w in weights.items()}
    assert deviation([r[0] for r in mixing.schedule(blocks, weights)], blocks, weights) < 1 + 1e-9  # in floating point


def test_mixing_with_columns_of_its_own_names(spark):
    rows = [(i, f"t{i}", f"s{i % 3}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    clash = docs.withColumns({c: F.lit("x") for c in (*mixing.MADE, "_bin", "_inner", "_base_bin", "_by_source", "_s", "_b", "_dice", "_rank")})
    want = {r.doc_id: r._position for r in mixing.mix_sources(docs).collect()}
    out = mixing.mix_sources(clash)
    assert out.columns[: len(clash.columns)] == clash.columns and out.columns[-5:] == [c + "_" for c in mixing.MADE]
    assert {r.doc_id: r._position_ for r in out.collect()} == want and out.where("_position <> 'x' or _by_source <> 'x'").count() == 0
    assert [r.doc_id for r in mixing.mixed(clash).collect()] == sorted(want, key=want.get)
    long = docs.where("doc_id < 3").withColumn("text", F.repeat(F.lit("long text "), 200000))
    assert mixing.mixed(long).where("length(text) = 2000000").count() == 3


def test_mixing_takes_any_number_of_sources(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", f"s{i % 300}" if i % 300 else None) for i in range(1500)], "doc_id bigint, text string, source string")
    want = sorted(map(tuple, mixing.mix_sources(docs, block=2).collect()))
    assert len(want) == 1500 and sorted({r[4] for r in want}) == list(range(900))
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 0)
    monkeypatch.setattr(mixing, "MOST_BINS", 0)
    assert sorted(map(tuple, mixing.mix_sources(docs, block=2).collect())) == want


def test_packed_prefixes_hold_the_target_weights(spark):
    source = {i: "hot" if i % 4 else f"s{i % 5}" for i in range(4000)}
    docs = spark.createDataFrame([(i, f"{i} word " * (60 if s == "hot" else 2), s) for i, s in source.items()], "doc_id bigint, text string, source string")
    scratch, at = cluster.Scratch(spark), docs
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for _, stage in corpus_pipeline.STAGES[3:]:
            at = scratch.save(stage(spark, at, ""))
        assert len(at.inputFiles()) > 1
        rows = at.select("doc_id", "sequence_id").orderBy("sequence_id").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    order = list(dict.fromkeys(r.doc_id for r in rows))
    assert sorted(order) == sorted(source)
    sizes = Counter(source.values())
    total, seen = sum(n**0.5 for n in sizes.values()), Counter()
    for t, i in enumerate(order, 1):
        seen[source[i]] += 1
        # A block of the source and the one being filled.
        assert all(abs(seen[s] - t * n**0.5 / total) < 2 * mixing.BLOCK for s, n in sizes.items())
        if seen[source[i]] == sizes[source[i]]:
            break


def whole_count(scores, longest, w):
    """Pieces on the best way through the whole string, ties to fewer."""
    best = [(0.0, 0)]
    for j in range(1, len(w) + 1):
        ways = [(best[i][0] + s, best[i][1] + 1) for i in range(max(0, j - longest), j) if (s := scores.get(w[i:j], counts.BYTE if j - i == 1 else None)) is not None]
        top = max(s for s, _ in ways)
        best.append((top, min(n for s, n in ways if s >= top - 1e-9)))
    return best[-1][1]


def test_long_pretokens_are_scored_whole(spark, tmp_path):
    random.seed(5)
    sizes = (85, 86, 253, 256, 257, 700)
    words = ["x" * 9000, "日本語の文章" * 200, "https://example.org/" + "some/path-" * 90, *["".join(random.choice("theinrsé") for _ in range(n)) for n in sizes]]
    texts = [*words, " ".join(words), "short words", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    scores = counts.fit_scores(spark.read.parquet(f"{tmp_path}/documents.parquet"), queries.public_file("piece_bpe_32k.model"))
    longest = max(map(len, scores))
    got = {r.doc_id: (r.n_pretokens, r.n_tokens) for r in queries.QUERIES["op5_token_counts"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        own = (text or "").encode().split()
        assert got[i] == (len(own), sum(whole_count(scores, longest, counts.MARK + w) for w in own)), i


def test_audit_has_links_to_find():
    """A graph whose beams find nothing is widened to the whole shard, though few vectors of it link."""

    class Blind:
        def __init__(self, x):
            self.x = x.astype(np.float32)

        def search(self, q, beam):
            return np.full((len(q), beam), -1), np.full((len(q), beam), -2.0)

    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    exact = unit(rng.normal(size=(400, 32)))
    assert graphs.audit_beam(Blind(exact), exact, 0.95)[0] >= 400  # planted ones only
    exact[1::2] = exact[::2]
    beam, asked, found = graphs.audit_beam(Blind(exact), exact, 0.95)
    assert beam >= 400 and asked == found > graphs.AUDIT_LINKS
    p = graphs.planted(exact, 0.95)
    assert len(p) == graphs.AUDIT and ((p @ exact.T).max(1) >= 0.95).all()
    one = graphs.planted(np.ones((3, 1)), 0.95)
    assert np.allclose(one, 1)


def test_vectors_of_one_id_and_of_many_tasks(spark, monkeypatch):
    """An id with two vectors counts once, whatever the rows' order; more tasks change nothing."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    x[150:] = x[:150] + rng.normal(size=(150, 8)).astype(np.float32) * 0.01
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x.tolist())] + [(7, [float(v) for v in x[20]])]
    frame = lambda r: spark.createDataFrame(r, "vec_id bigint, embedding array<float>")
    want = sorted(map(tuple, graphs.near_vectors(frame(rows)).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert len(want) == 301 and sum(r[1] for r in want) >= 298
    monkeypatch.setattr(graphs, "QUERY_ROWS", 70)
    again = graphs.near_vectors(frame(rows[::-1])).collect()
    assert sorted(tuple(r)[:4] for r in again) == want
    assert again[0].audit_links > 0 and again[0].audit_found >= graphs.RECALL * again[0].audit_links


def test_shards_of_many_small_sources(spark):
    """Sources of one row all stand at the same fraction: they are spread over partitions, and shards differ by one row at most."""
    from lodestone.llm import sharding

    rows = [(i, f"text {i}", f"s{i}") for i in range(3000)] + [(10_000 + i, "x", "big") for i in range(500)]
    out = sharding.shards(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), n_shards=7).collect()
    counts = np.bincount([r.shard for r in out], minlength=7)
    assert len(out) == 3500 and counts.max() - counts.min() <= 1
    assert sorted(r.position for r in out) == list(range(3500))
    big = np.bincount([r.shard for r in out if r.source == "big"], minlength=7)
    order = [r.fraction for r in sorted(out, key=lambda r: r.position)]
    assert order == sorted(order) and big.sum() == 500


def test_fit_takes_one_row_an_id(spark):
    """Thousands of rows of one labelled id count as one; the order of rows plays no part."""
    rows = [(i, ("awful vile hate " if i % 2 else "calm kind day ") * 4 + f"w{i}") for i in range(60)]
    hot = [(1, "awful vile hate " * 4 + f"again {i}") for i in range(3000)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, toxic int")
    df = spark.createDataFrame(rows + hot, "doc_id bigint, text string")
    seen = []
    kept = toxicity.cross_fitted_grades
    toxicity.cross_fitted_grades = lambda own, *more: seen.append(len(own)) or kept(own, *more)
    try:
        one, two = toxicity.fit(df, labels), toxicity.fit(df.repartition(9), labels)
        toxicity.fit(df, labels, most=2)
    finally:
        toxicity.cross_fitted_grades = kept
    assert seen[:2] == [60, 60] and all(n <= 2 for n in seen[2:])
    assert np.allclose(one.weights, two.weights) and np.array_equal(one.numbers, two.numbers)


def test_text_of_very_many_repeated_lines(spark):
    """Lines that go are looked up in one step each."""
    from lodestone.llm import lines

    rows = [(1, "\n".join(["same line"] * 20_000 + ["other"])), (2, "x\nsame line\ny"), (3, None), (4, "")]
    out = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), levels=()).collect()}
    assert out == {1: ("same line\nother", 20_001, 19_999), 2: ("x\ny", 3, 1), 3: (None, 0, 0), 4: ("", 0, 0)}


def test_probes_are_made_once_and_in_one_pass(spark, tmp_path):
    """The optimiser's test for null keys made each probe's hash twice; each level of lines took a scan of its own."""
    texts = [f"{k % 7} " * (15 + k) for k in range(90)]
    spark.createDataFrame([(k, t.encode()) for k, t in enumerate(texts)], "node bigint, line binary").write.parquet(f"{tmp_path}/kinds")
    kinds = spark.read.parquet(f"{tmp_path}/kinds")
    keys = lines.segment_keys(kinds, lines.LEVELS, True)
    met = cluster.likely_in(keys, "key", keys.select("key").limit(5), "key")
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "isnotnull((xxhash64" not in plan and "isnotnull(pmod" not in plan
    assert keys._jdf.queryExecution().optimizedPlan().toString().count("Generate inline") == 1
    # Lines at the ends of levels take part in both.
    for probes in (False, True):
        want = set()
        for node, text in enumerate(texts):
            line = text.encode()
            for k, (low, e) in enumerate(lines.LEVELS):
                high = lines.LEVELS[k + 1][0] if k + 1 < len(lines.LEVELS) else 1 << 30
                for less, i, shift, probe in lines.segment_places(e):
                    size = len(line) - less
                    sizes = [size // (e + 1) + (j >= e + 1 - size % (e + 1)) for j in range(e + 1)]
                    start = sum(sizes[: i - 1]) + shift
                    if probe == probes and low <= size < high and 0 <= start <= len(line) - sizes[i - 1]:
                        want.add((node, size, i, line[start : start + sizes[i - 1]]))
        asked = spark.createDataFrame(list(want), "id bigint, size int, i int, part binary").selectExpr("xxhash64(size, i, part) key", "id")
        got = lines.segment_keys(kinds, lines.LEVELS, probes).select("key", "id").distinct()
        assert got.count() == asked.distinct().count() == got.intersect(asked).count()


def test_components_of_few_and_many_links(spark, monkeypatch):
    """One task or all: the same components."""
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60) if k % 7] + [(3, 80), (80, 41), (9, 9)], "a bigint, b bigint")
    of = lambda: {tuple(r) for r in cluster.components(links, cluster.Scratch(spark)).collect()}
    few = of()
    monkeypatch.setattr(cluster, "FEW_LINKS", 0)
    assert few == of() and len({c for _, c in few}) == 8


def test_few_links_take_no_rounds(spark, monkeypatch):
    """Few links cost one table whatever their chain's length; ids of other types go by tables."""
    chain = spark.createDataFrame([(k, k + 1) for k in range(100)] + [(7, 7), (-3, 200)], "a bigint, b bigint")
    scratch = cluster.Scratch(spark)
    got = {tuple(r) for r in cluster.components(chain, scratch).collect()}
    assert got == {(k, 0) for k in range(101)} | {(-3, -3), (200, -3)} and scratch.n == 1
    for kind in ("string", "decimal(9,1)"):
        own = spark.createDataFrame([("10", "9"), ("9", "3.5"), ("70", "8")], "a string, b string").selectExpr(f"cast(a as {kind}) a", f"cast(b as {kind}) b")
        found = cluster.components(own, cluster.Scratch(spark))
        few = {tuple(r) for r in found.collect()}
        with monkeypatch.context() as m:
            m.setattr(cluster, "FEW_LINKS", 0)
            assert few == {tuple(r) for r in cluster.components(own, cluster.Scratch(spark)).collect()} and len({c for _, c in few}) == 2
        assert [f.dataType.simpleString() for f in found.schema] == [kind, kind]


def test_fitted_rows_come_as_arrow(spark, monkeypatch):
    """The fit's lists of features aren't boxed and pickled number by number on the driver; the rows' order is the id's."""
    docs = spark.createDataFrame([(k, "vile awful words here" if k % 2 else f"kind calm words {k}") for k in range(40, 0, -1)], "doc_id bigint, text string").repartition(7)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 41)], "doc_id bigint, toxic int")

    def refuse(self):
        raise AssertionError("rows were pickled")

    monkeypatch.setattr(type(docs), "toPandas", refuse)
    one, two = toxicity.fit(docs, labels), toxicity.fit(docs.coalesce(1), labels)
    assert len(one.numbers) and (one.numbers == two.numbers).all() and (one.weights == two.weights).all() and (one.thresholds == two.thresholds).all()
    assert {r.doc_id for r in toxicity.reject(docs, one).collect()} == set(range(2, 41, 2))
