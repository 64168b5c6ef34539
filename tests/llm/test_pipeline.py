"""All five stages of the pipeline against a version without Spark, hashing or candidates, and its edge cases."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import lines, mixing, queries, toxicity
from lodestone.llm.words import LOWER

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
STAGES = dict(corpus_pipeline.STAGES)


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


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y)))
        prev = row
    return prev[-1]


def edits(n):
    return max([e for low, e in lines.LEVELS if n >= low], default=0)


def without_lines(docs):
    places = {}
    for i, text in docs.items():
        for k, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                places.setdefault(line.encode(), []).append((i, k))
    kinds = sorted(places)
    links = [(a, b) for k, a in enumerate(kinds) for b in kinds[:k] if abs(len(a) - len(b)) <= (e := edits(min(len(a), len(b)))) and e and distance(a, b) <= e]
    root, gone = groups(kinds, links), set()
    for c in set(root.values()):
        gone |= set(sorted(p for k in kinds if root[k] == c for p in places[k])[1:])
    out = {}
    for i, text in docs.items():
        own = (text or "").split("\n")
        kept = [x for k, x in enumerate(own) if (i, k) not in gone]
        if len(kept) == len(own):
            out[i] = text
        elif any(x.strip() for x in kept):
            out[i] = "\n".join(kept)
    return out


def without_copies(docs):
    def shingles(text):
        w = (text or "").encode().translate(bytes(LOWER)).split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, ids = {i: shingles(t) for i, t in docs.items()}, sorted(docs)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = groups(ids, links)
    return {i: docs[i] for i in ids if root[i] == i}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Labelled documents with toxic ones, shared and nearly shared lines, copies, near copies, and odd texts."""
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randint(3, 8)))
    lines_ = [" ".join(word() for _ in range(random.randint(2, 30))) for _ in range(12)]
    rows, labels, base = [], [], " ".join(word() for _ in range(90))
    for i in range(320):
        own = [" ".join(word() for _ in range(random.randint(3, 25))) for _ in range(random.randint(1, 4))]
        if random.random() < 0.4:
            line = list(random.choice(lines_))
            for _ in range(random.choice([0, 0, 1, 2, 4])):
                line[random.randrange(len(line))] = "z"
            own.insert(random.randrange(len(own) + 1), "".join(line))
        bad = i % 8 == 0
        if bad:
            own.append(" ".join([word(), *["nastyword vileinsult hatefulthing"] * 2]))
        text = "\n".join(own)
        if i % 11 == 10 and not bad:
            w = base.split(" ")
            for _ in range(random.randint(0, 5)):
                w[random.randrange(len(w))] = "q" * 12 + word()
            text = " ".join(w)
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 4}", len(text)))
        if i < 240:
            labels.append((i, 1, int(bad)))
    rows += [(1000, None, "en", None, None), (1001, "", "en", "s1", 0), (1002, "\n \n", "en", "s2", 3), (1003, "long word " * 20000, "en", "s1", 200000)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{at}/labels.parquet")
    return at, rows


def test_all_stages_against_brute_force(spark, corpus):
    from tokenizers import Tokenizer

    at, rows = corpus
    docs = spark.read.parquet(f"{at}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{at}/labels.parquet"))
    calls = {r.doc_id: r.toxic for r in toxicity.score(docs, model).collect()}  # its scores are held against plain ones in test_single_pass
    text = {r[0]: r[1] for r in rows if not calls[r[0]]}
    assert 20 < len(rows) - len(text) < 80
    fewer = without_lines(text)
    want = without_copies(fewer)
    assert any(fewer[i] != text[i] for i in fewer) and len(want) < len(fewer)
    sources = {r[0]: r[3] for r in rows}
    sizes = Counter(sources[i] for i in want)
    order = [s for s, _, _, _ in mixing.schedule({s: -(-n // mixing.BLOCK) for s, n in sizes.items()}, {s: n**0.5 for s, n in sizes.items()})]
    got = corpus_pipeline.run(spark, at).orderBy("sequence_id").collect()
    tok, own = Tokenizer.from_file(queries.public_file("word_bpe_49k.json")), {}
    for r in got:
        own.setdefault(r.doc_id, []).append(r)
    assert set(own) == set(want)
    for i, pieces in own.items():
        pieces.sort(key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in pieces]).tolist()
        assert ids == [*tok.encode(want[i] or "", add_special_tokens=False).ids, 1], i
    # The sequences come in blocks of the sources in the schedule's order.
    seen = [sources[i] for i in dict.fromkeys(r.doc_id for r in got)]
    left, expect = Counter(sizes), []
    for s in order:
        n = min(mixing.BLOCK, left[s])
        expect += [s] * n
        left[s] -= n
    assert seen == expect


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_clashing_names_repeats_nulls_and_empty_tables(spark, corpus, name):
    at, rows = corpus
    more = [(1, rows[1][1], "en", "hot", 5), (1, rows[1][1], "en", "hot", 5), (None, "no id " * 9, "en", "s1", 5)]
    docs = spark.createDataFrame(rows[:40] + more + rows[-4:], SCHEMA)
    names = ("id", "text_", "n_removed", "_gone", "_id", "_th", "_position", "_bin", "_inner", "_node", "y", "h", "g", "component", "kept", "row", "length", "offset")
    clash = docs.withColumns({c: F.lit("x") for c in names})
    plain, odd = STAGES[name](spark, docs, at), STAGES[name](spark, clash, at)
    if name == "packing":
        plain, odd = plain.select("doc_id", "start", F.crc32("ids").alias("ids")), odd.select("doc_id", "start", F.crc32("ids").alias("ids"))
    else:
        assert odd.columns == clash.columns and odd.where(" or ".join(f"`{c}` <> 'x' or `{c}` is null" for c in names)).count() == 0
        odd = odd.select(*docs.columns)
    got = sorted(map(str, plain.collect()))
    assert got == sorted(map(str, odd.collect())) and any("no id" in x or "doc_id=None" in x for x in got)
    if name != "line_dedup":  # there, lines of the repeated rows stand in their first place
        assert sum(x.startswith("Row(doc_id=1,") for x in got) >= (3 if name != "packing" else 3)
    empty = STAGES[name](spark, docs.limit(0), at)
    assert empty.count() == 0
