"""Phrase collocations, whitening and exact dedup against brute-force versions, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact, phrases, whitening

SCHEMA = "doc_id bigint, text string, lang string"


def test_exact_names_against_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(0, 90))) for _ in range(300)]
    texts += [t.replace("a", " a\t") for t in texts[:120]] + [None, "", " \n", "x" * 500, "x" * 499, "x" * 512 + "y", "é\x0bé", "éé", "e e", "e e"] + ["hot copy"] * 200
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(3, texts[3], None), (None, "hot copy", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumns({c: F.lit(1) for c in ("r", "name", "level", "block", "kept")})
    for bits in (64, 4):  # four bits clash, so that seeds are drawn again
        got = exact.exact_duplicates(df, block=16, bits=bits).collect()
        plain = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups = {}
        for i, t, _ in rows:
            groups.setdefault(plain(t), []).append((-len(t or ""), i is None, i or 0, i))
        want = sorted((str(i), str(min(groups[plain(t)])[3]), len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for i, t, _ in rows)
        assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in got) == want
        kept = [r for r in got if r["kept"]]
        assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
        names = {(r["level"], r["name"]): r["text_sha256"] for r in got}
        assert len(names) == len(groups) == len(set(names.values()))
    assert exact.exact_duplicates(df.where("false")).collect() == []


def test_exact_names_long_text(spark):
    long = "word " * 400_000
    got = exact.exact_duplicates(spark.createDataFrame([(1, long, "x"), (2, long + " ", "x"), (3, long + "!", "x")], SCHEMA)).orderBy("doc_id").collect()
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in got] == [(2, 2, False), (2, 2, True), (3, 1, True)]


def mined(rows, least, top):
    """The contract by plain loops."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    for p, a in candidates.items():
        lang, w = p[0], p[1:]
        inside = [b for q, b in candidates.items() if q[0] == lang and len(q) > len(p) and any(q[i : i + len(w)] == w for i in range(1, len(q)))]
        if any(100 * b >= 80 * a for b in inside):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, *w[:k]] + f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, l, r, n[lang], score))
    best = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        best += [(lang, i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(best)


def corpus():
    rng = random.Random(3)
    vocabulary = ["The", "the", "of", "É", "é", "日本", "a-b", "<x>", "'s", " ", "new", "york", "city", "hall"]
    rows = []
    for i in range(400):
        words = rng.choices(vocabulary, weights=range(1, 15), k=rng.randrange(0, 40))
        if rng.random() < 0.5:
            words += ["new", "york", "city", "hall"]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in words)
        rows.append((i, text, rng.choice(["en", "en", "de", None, ""])))
    return rows + [(1, None, "en"), (2, "", None), (3, "... ,,", "xx"), (None, "new york " * 200, "en"), (5, "lonely", "only")] * 2


@pytest.mark.parametrize("cells", [64, 1 << 12])
def test_collocations_against_loops(spark, cells):
    """A sketch of 64 cells lets nearly all pass and still gives the same rows."""
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({c: F.lit(1) for c in ("k", "phrase", "a", "chunk", "n")})
    got = phrases.collocations(df, least=6, top=25, cells=cells).collect()
    assert sorted(tuple(r) for r in got) == mined(rows, 6, 25)
    assert phrases.collocations(df.where("false")).collect() == []


def test_collocations_large_counts_and_long_texts(spark, monkeypatch):
    """Cells of two bytes for a threshold over 255; texts in several windows."""
    monkeypatch.setattr(phrases, "WINDOW_BYTES", 700)
    rows = [(i, "Big apple pie, " * 300 + "big deal; " * 5, "en") for i in range(3)] + [(9, "no end " * 400, "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in phrases.collocations(df, least=300, top=50).collect()) == mined(rows, 300, 50)


def test_sketch_never_counts_less():
    rng = np.random.default_rng(0)
    hashes = rng.zipf(1.3, 40_000).astype(np.uint64)
    sketch = phrases.Sketch(256, 40)
    for part in np.array_split(hashes, 7):
        sketch.add(part)
    kinds, n = np.unique(hashes, return_counts=True)
    low = np.min([sketch.counts[r, phrases.places(kinds, r, 256)] for r in range(phrases.DEPTH)], 0)
    assert (low >= np.minimum(n, 40)).all()
    seen = phrases.Filter(256, {k: np.packbits(np.frombuffer(c, np.uint8) >= 40).tobytes() for k, c in sketch.chunks()})
    assert seen.passes(kinds)[n >= 40].all() and (seen.passes(kinds) == (low >= 40)).all()


def test_scores_past_64_bits(spark):
    counts = spark.createDataFrame([("x", 0, "", 9 * 10**17), ("x", 1, "a", 5 * 10**17), ("x", 1, "b", 4 * 10**17), ("x", 2, "a b", 3 * 10**17)], "lang string, k int, phrase string, f bigint")
    (row,) = phrases.scored(counts).collect()
    assert row["score"] == 2000000 * 3 // 9 and row["n"] == 9 * 10**17
    assert phrases.unsubsumed(phrases.scored(counts)).count() == 1


def whitened(rows, k=4):
    """The contract in numpy: (fit list size, S, eigenvalues, vectors, x by row)."""
    sound = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    width = max(len(v) for _, v in sound)
    x = [(i, tuple(int(np.floor(256 * np.float64(c))) for c in v)) for i, v in sound if len(v) == width]
    fit = np.array(sorted({v for _, v in x}), np.float64)
    values, vectors = np.linalg.eigh(np.cov(fit.T, bias=True))
    return len(fit), fit.sum(0), values[::-1], vectors[:, ::-1], x


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(500, 20)) * np.linspace(3, 0.5, 20)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(data)]
    rows += [(900 + i, rows[7][1]) for i in range(300)] + [(1, rows[1][1]), (None, rows[2][1]), (2000, None), (2001, []), (2002, [1.0] * 19 + [None]), (2003, [1.0] * 19 + [float("nan")]), (2004, [float("inf")] * 20), (2005, [1.0] * 5), (2006, [-0.0] * 20)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(5).withColumns({c: F.lit(1) for c in ("id", "x", "v", "component", "n", "i")})
    n, sums, values, vectors, x = whitened(rows)
    for tile, block_rows in ((32, 4096), (6, 64)):
        got = whitening.whiten(df, tile=tile, block_rows=block_rows).collect()
        assert len(got) == 4 * len(x) and {r["n"] for r in got} == {n}
        assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
        want = {}
        for i, v in x:
            w = (np.array(v) - sums / n) @ vectors[:, :4] / np.sqrt(values[:4])
            want.setdefault(i, (sum((n * c - int(s)) ** 2 for c, s in zip(v, sums)), w))
        signs = {}
        for r in got:
            deviation, w = want[r["vec_id"]]
            c = r["component"] - 1
            sign = signs.setdefault(c, np.sign(w[c]) * np.sign(r["whitened"]))
            assert r["deviation"] == deviation and abs(r["whitened"] - sign * w[c]) < 1e-8 and abs(r["explained"] / (values[c] / values.sum()) - 1) < 1e-9
    assert whitening.whiten(df.where("false")).collect() == []
    assert whitening.whiten(df.where("vec_id >= 900 and vec_id < 1000")).collect() == []  # one distinct vector has no spread


def test_whitening_deviation_past_64_bits(spark):
    rows = [(i, [1e7 * i, float(-i * i)]) for i in range(40)]
    rows += [(99, [3e15, 0.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), components=1).collect()}
    n, sums, _, _, x = whitened(rows)
    sums = [sum(v[d] for v in {v for _, v in x}) for d in range(2)]
    exactly = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for i, v in x}
    assert got == {i: e if e < 2**63 else None for i, e in exactly.items()} and None in got.values()
