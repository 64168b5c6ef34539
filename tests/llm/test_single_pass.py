"""Media, packing, counts, licences and toxicity against brute-force versions, and their edge cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import counts, licences, media, packing, toxicity, words
from lodestone.llm.queries import public_file

EDGE = [(1, None), (2, ""), (3, "   \n\t"), (4, "One two three four five six."), (4, "One two three four five six."), (5, "ÉÀ naïve 日本語 don't <|endoftext|> x"), (6, "word " * 60000), (7, "x" * 9000), (None, "no id")]
SCHEMA = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def docs(spark):
    """Edge cases with extra columns whose names the operators use inside."""
    return spark.createDataFrame(EDGE, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "media", "row", "ids", "component_id", "length")})


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=6))
def test_words_and_hashes(texts):
    t = words.Texts(pa.array(texts))
    for gaps, pattern in ((words.SPACES, rb"[^\x20\x09-\x0D]+"), (words.NON_ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        starts, ends, first = words.word_spans(t, gaps)
        seen = {}
        for h, a, b in zip(words.span_hashes(t, starts, ends).tolist(), starts, ends):
            assert seen.setdefault(h, t.data[a:b].tobytes().lower()) == t.data[a:b].tobytes().lower()
        for i, text in enumerate(texts):
            raw = text.encode().translate(bytes(words.LOWER))
            own = [raw[a - t.offsets[i] : b - t.offsets[i]] for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
            assert own == re.findall(pattern, raw)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 40), st.integers(0, 2**32 - 1))
def test_media_round_trip_and_resynchronisation(units, seed):
    payload = np.random.default_rng(seed).integers(0, 256, units * media.UNIT, np.uint8).tobytes()
    stream = media.encode(payload)
    p = media.parse(stream)
    assert media.payload_of(stream, p) == payload and p["crc_bad"] == p["sync_losses"] == p["skipped"] == 0
    assert p["vbr"]["frames"] == len(p["offsets"]) and p["samples"] == 1152 * len(p["offsets"]) and p["vbr"]["bytes"] == len(stream) - media.id3v2(stream)[0]
    tagged = stream + b"TAG" + bytes(125)
    assert media.parse(tagged)["offsets"] == p["offsets"]
    cut = p["offsets"][-1]
    if len(p["offsets"]) < 2:
        return
    broken = media.parse(stream[:cut] + b"\x00junk" + stream[cut:])
    assert len(broken["offsets"]) == len(p["offsets"]) and broken["skipped"] == 5 and broken["sync_losses"] == 1
    for k in range(len(p["offsets"])):  # junk before any frame loses nothing
        cut_k = p["offsets"][k]
        spoilt = stream[:cut_k] + b"\x00junk" + stream[cut_k:]
        assert media.payload_of(spoilt, media.parse(spoilt)) == payload
    flipped = bytearray(stream)
    flipped[cut + 8] ^= 1  # in the side information
    assert media.parse(bytes(flipped))["crc_bad"] == 1


def test_media_headers():
    h = media.header(bytes((0xFF, 0xFB, 0x90, 0x00)))
    assert (h.rate, h.length, h.samples, h.channels, h.side) == (44100, 417, 1152, 2, 32)
    assert media.header(bytes((0xFF, 0xF3, 0x90, 0xC0))).samples == 576 and media.header(b"\xff\xff\xff\xff") is None and media.header(b"ab") is None
    assert media.parse(b"")["offsets"] == [] and media.parse(b"no audio")["skipped"] == 8


def plain_crc(bits):
    c = 0xFFFF
    for bit in bits:
        c = ((c << 1) ^ (0x8005 if (c >> 15) ^ bit else 0)) & 0xFFFF
    return c


@pytest.mark.parametrize("four", [(0xFF, 0xFE, 0x90, 0x00), (0xFF, 0xFE, 0x90, 0xC0), (0xFF, 0xFE, 0x90, 0x50), (0xFF, 0xFC, 0xA4, 0x00), (0xFF, 0xFC, 0xA4, 0x60), (0xFF, 0xFC, 0x58, 0xC0), (0xFF, 0xFC, 0x28, 0xC0), (0xFF, 0xF4, 0x80, 0x00)])
def test_checksums_of_layers_one_and_two(four):
    """Frames of random allocations: the checksum by bits, read back, and broken by one bit of what it covers."""
    random.seed(sum(four))
    h = media.header(bytes(four))
    body = bytearray(random.randrange(256) for _ in range(h.length - 6))
    n = media.covered_bits(bytes(four), h, bytes(body))
    assert 0 < n <= 8 * len(body)
    bits = lambda data: [b >> k & 1 for b in data for k in range(7, -1, -1)]
    c = plain_crc(bits(bytes(four[2:])) + bits(bytes(body))[:n])
    frame = bytes(four) + c.to_bytes(2, "big") + bytes(body)
    p = media.parse(frame * 3)
    assert (len(p["offsets"]), p["crc_checked"], p["crc_bad"]) == (3, 3, 0)
    broken = bytearray(frame * 3)
    broken[6] ^= 128
    assert media.parse(bytes(broken))["crc_bad"] == 1
    if h.layer == 1:
        modes = {0x00: 256, 0xC0: 128, 0x50: 4 * (2 * 8 + 24)}
        assert n == modes[four[3]]


def test_media_query(spark, docs):
    got = media.read(media.store(docs), ["doc_id", "n_bytes"]).collect()
    assert len(got) == len(EDGE)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    for i, text in EDGE:
        raw = (text or "").encode()
        padded = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    odd = spark.createDataFrame([(1, None), (2, bytearray(b"xyz"))], "k int, media binary")
    assert [(r.frames, r.skipped_bytes) for r in media.read(odd, ["k"]).orderBy("k").collect()] == [(0, 0), (0, 3)]
    assert media.read(media.store(docs.limit(0)), ["doc_id"]).count() == 0


def test_packing_units():
    """Words that differ by case and signs share a unit, and cuts change no id."""
    from tokenizers import Tokenizer

    path = public_file("word_bpe_49k.json")
    encoder, plain, sent = packing.TextIds(path), Tokenizer.from_file(path), []
    fill = encoder.table.fill
    encoder.table.fill = lambda words: sent.extend(words) or fill(words)
    encoder.ids(words.Texts(pa.array(["Word word, word. (word) WORD! naïve, naïve. x1 x22"])))
    assert len(sent) == len(set(sent)) == len({b"word", b",", b".", b"(", b")", b"!", "naïve".encode(), b"x", b"1", b"2"})
    alphabet = [*"abtlmdIJW'’.,&|<>09 \n\x00\x1c", "'s", "'RE", "<|endoftext|>", "<|ENDOFTEXT|>", "É", "İ", "×", "…", "\u030c", "\u0307", "\u0338", "ß", "Σ", "ſ", "中", "ᄒ", "ᅡ", "\u00a0", "²", "😀", "Ǆ", "E\u0301"]
    rng = random.Random(5)
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(14))) for _ in range(5000)]
    ids, counts_of = encoder.ids(words.Texts(pa.array(texts)))
    want = [plain.encode(t, add_special_tokens=False).ids + [packing.CLOSE] for t in texts]
    assert counts_of.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = public_file("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    rows = packing.pack(docs, path).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and all(r.length == 2048 or r.length & (r.length - 1) == 0 for r in rows)
    for i, text in {k: v for k, v in EDGE}.items():
        want = [*tok.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: (r.start, r.sequence_id))
        own = own[:: 2 if i == 4 else 1]
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist()
        assert ids == want and all(r.doc_tokens == len(want) and r.offset == 0 and r.bucket == r.length.bit_length() - 1 for r in own)
    assert packing.pack(docs.limit(0), path).count() == 0


def brute_pieces(unigram, scores, w):
    best = [(0.0, 0)] + [None] * len(w)
    for j in range(1, len(w) + 1):
        options = []
        for i in range(max(0, j - unigram.lengths[-1]), j):
            s = scores.get(w[i:j], counts.BYTE if j - i == 1 else None)
            if s is not None:
                options.append((best[i][0] + s, best[i][1] + 1))
        top = max(o[0] for o in options)
        best[j] = (top, min(o[1] for o in options if o[0] >= top - 1e-9))
    return best[-1][1]


def test_token_counts(spark, docs):
    import sentencepiece

    path = public_file("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = counts.fit_scores(docs, path)
    seen = {}
    for _, text in EDGE:
        for w in re.split(r"[ \t-\r]+", text or ""):
            for x in model.encode(w) if w else []:
                seen[x] = seen.get(x, 0) + 1
    total = sum(seen.values()) + model.vocab_size()
    for x, piece in list(counts.ordinary_pieces(path).items()):
        assert scores[piece] == pytest.approx(np.log((seen.get(x, 0) + 1) / total))
    unigram = counts.Unigram(scores)
    got = counts.token_counts(docs, path, scores).collect()
    assert len(got) == len(EDGE)
    for i, text in EDGE:
        if i == 6:
            continue
        want = sum(brute_pieces(unigram, scores, counts.MARK + w) for w in (text or "").encode().split())
        assert {(r.n_pretokens, r.n_tokens) for r in got if r.doc_id == i} == {(len((text or "").split()), want)}
    assert counts.token_counts(docs.limit(0), path, counts.fit_scores(docs.limit(0), path)).count() == 0


def test_words_with_equal_hashes_are_told_apart():
    from lodestone.llm.vocab import WordTable

    asked = []

    def fill(words_):
        asked.append(list(words_))
        return [[len(w), w[0]] for w in words_]

    table = WordTable(fill)
    texts = ["ab cd ab", "longer-than-sixteen-bytes-a longer-than-sixteen-bytes-b x", "ab longer-than-sixteen-bytes-b"]
    for text in texts:
        t = words.Texts(pa.array([text]))
        starts, ends, _ = words.word_spans(t, words.SPACES)
        at, size = table.look(t, starts, ends, np.zeros(len(starts), np.uint64))
        assert [table.pool[a : a + n].tolist() for a, n in zip(at, size)] == [[len(w), w[0]] for w in text.encode().split()]


def test_licences(spark, docs):
    full = {label: text for label, text in reversed(licences.notices())}  # the first of each label
    notice = dict(licences.notices())["mit"].split()
    texts = {10: "Released Under the MIT License. under-the mit license", 11: "the Apache License, Version 2.0 and CC BY-NC 4.0!", 12: " ".join(notice[:10] + ["extra", "words"] + notice[10:]), 13: "mit license", 14: "clean text about cc by chance nc", 15: "under the mit license " * 300}
    texts |= {16: "x y z " + full["bsd-3"].replace("copyright", "COPYRIGHT") + " tail", 17: full["apache-2"].upper(), 18: "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", 19: " ".join(full["mit"].split()[:30]), 20: "this software is provided free of charge to any person", 21: full["mit"] + "\n\n" + full["isc"]}
    rows = docs.select("doc_id", "text", "row").union(spark.createDataFrame([*[(k, v, "x") for k, v in texts.items()], (21, "other text", "y")], "doc_id bigint, text string, row string"))
    got = {}
    out = licences.scan(rows).collect()
    assert len(out) == len(EDGE) + len(texts) + 1
    for r in out:
        if r.doc_id != 21 or r.n_words > 2:
            got[r.doc_id] = r
        else:
            assert r.labels == ""
    for i, text in [*EDGE, *texts.items()]:
        low = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes(words.LOWER)))
        places, labels = [], set()
        for phrase, label in licences.PHRASES:
            p = phrase.encode().split()
            hits = [k for k in range(len(low)) if low[k : k + len(p)] == p]
            places += hits
            labels |= {label} if hits else set()
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(low), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert labels <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert got[12].labels == "mit" and got[12].base_labels == "" and got[13].labels == "" and got[14].labels == ""
    assert [got[k].labels for k in (16, 17, 18, 19, 20, 21)] == ["bsd-3", "apache-2", "cc-by-nc", "mit", "", "isc,mit"]
    assert got[16].spans[0].start == 3 and got[16].score == 1 and got[19].score >= licences.COVER
    assert licences.scan(docs.limit(0)).count() == 0


def brute_labels(low, templates):
    """Notices by the longest common subsequence with every window, without votes: the labels that may stand."""
    out = set()
    for text, label, whole in templates:
        t = [w for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.encode().translate(bytes(words.LOWER)))]
        if whole:
            out |= {label} if any(low[k : k + len(t)] == t for k in range(len(low))) else set()
            continue
        for k in range(len(low)):
            w, row = low[k : k + len(t) + 6], [0] * (len(t) + 1)
            for x in w:
                prev = 0
                for j, y in enumerate(t, 1):
                    prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
            if row[-1] >= licences.COVER * len(t):
                out.add(label)
    return out


def test_notices_with_edits_against_every_window(spark):
    """Templates longer than 64 words, and texts with words changed, left out and put in."""
    random.seed(9)
    word = lambda: random.choice(["alpha", "beta", "gamma", "delta", "to", "the", "of"]) + random.choice("abcdefgh")
    templates = [("under the mit license", "mit", True), (" ".join(word() for _ in range(90)), "long", False), (" ".join(word() for _ in range(14)), "short", False)]
    texts = []
    for i in range(60):
        own = [word() for _ in range(random.randint(0, 40))]
        for t, _, _ in random.sample(templates, random.randint(0, 2)):
            w = t.split()
            for _ in range(random.choice([0, 1, 4, 30])):
                k = random.randrange(len(w))
                w[k : k + 1] = random.choice([[], [w[k], "odd"], ["odd"]])
                if not w:
                    break
            at = random.randint(0, len(own))
            own[at:at] = w or ["x"]
        texts.append(" ".join(own))
    texts.append("toa under the mit license ofb")
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    seen = set()
    for r in licences.scan(rows, templates=templates).collect():
        low = texts[r.doc_id].encode().split()
        want = brute_labels(low, templates)
        got = set(r.labels.split(",")) - {""}
        seen |= got
        assert got <= want, r.doc_id
        for s in r.spans:
            assert 0 <= s.start < s.end <= len(low) and s.cover >= licences.COVER
        # Votes need runs of three words: a text with few edits is never missed.
        for t, label, _ in templates:
            if f" {t} " in f" {texts[r.doc_id]} ":
                assert label in got
    assert seen == {"mit", "long", "short"}
    with pytest.raises(ValueError):
        licences.scan(rows, templates=[("two words", "x", False)])


def plain_objective(p, has, grades, n_grades, ridge):
    """The penalised log likelihood of weights, first threshold and logs of gaps, row by row."""
    k = len(p) - (n_grades - 1)
    w, cut = p[:k], [p[k]]
    for g in p[k + 1 :]:
        cut.append(cut[-1] + np.exp(g))
    total = -0.5 * ridge * sum(x * x for x in w)
    for own, grade in zip(has, grades):
        z = sum(w[j] for j in own)
        edge = lambda j: 0.0 if j < 0 else 1.0 if j >= n_grades - 1 else 1 / (1 + np.exp(-(cut[j] - z)))
        total += np.log(max(edge(grade) - edge(grade - 1), 1e-12))
    return total


@pytest.mark.parametrize("n_grades", [2, 4])
def test_fit_reaches_the_maximum_of_plain_gradient_ascent(n_grades):
    rng = np.random.default_rng(n_grades)
    has = [sorted(rng.choice(4, rng.integers(0, 4), replace=False).tolist()) for _ in range(60)]
    grades = np.array([min(n_grades - 1, max(0, len(h) + int(rng.integers(-1, 2)))) for h in has])
    rows, columns = np.repeat(np.arange(60), [len(h) for h in has]), np.array([j for h in has for j in h])
    w, cut = toxicity.fit_link(rows, columns, grades, 4, n_grades, steps=800)
    assert (np.diff(cut) > 0).all()
    own = plain_objective(np.concatenate([w, cut[:1], np.log(np.diff(cut))]), has, grades, n_grades, 0.5)
    p, rate = np.zeros(4 + n_grades - 1), 0.02
    for _ in range(600):
        slope = np.array([(plain_objective(p + d, has, grades, n_grades, 0.5) - plain_objective(p - d, has, grades, n_grades, 0.5)) / 2e-5 for d in np.eye(len(p)) * 1e-5])
        p = p + rate * slope
    best = plain_objective(p, has, grades, n_grades, 0.5)
    assert own >= best - 0.02 and np.allclose(w, p[:4], atol=0.1)


def plain_features(text):
    low = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(bytes(words.LOWER)))
    return {(n, w[:n] if n else w) for w in low for n in (0, *toxicity.PREFIXES) if len(w) > n}


def test_toxicity_fits_and_rejects(spark):
    random.seed(4)
    base = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "tau", "rho"]
    rows, labels = [], []
    for i in range(600):
        w = [random.choice(base) + random.choice(base) for _ in range(random.randint(5, 80))]
        bad = i % 5 == 0
        for _ in range(random.randint(1, 6) if bad else 0):
            w.insert(random.randrange(len(w)), random.choice(["nastyword", "vileinsult", "hatefulthing"]))
        rows.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1000, None)], SCHEMA).withColumn("_text", F.lit(1))
    known = spark.createDataFrame([*labels, (5000, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, known)
    assert list(model.thresholds) == sorted(model.thresholds)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400, 600)]
    assert np.mean([got[i].toxic == (i % 5 == 0) for i in held]) > 0.98
    assert not got[1000].toxic and 0 <= got[5].severity <= 3
    assert all(abs(got[i].p_toxic - got[i].p_grade_1 - got[i].p_grade_2 - got[i].p_grade_3) < 1e-9 for i in held)
    # Scores by hand, from the features' own texts.
    number = {}
    for i, text in rows:
        for n, w in plain_features(text):
            t = words.Texts(pa.array([w.decode()]))
            number[n, w] = int((words.mix(words.span_hashes(t, np.array([0]), np.array([len(w)])), n) >> np.uint64(64 - toxicity.BITS))[0])
    weight = dict(zip(model.numbers.tolist(), model.weights.tolist()))
    assert any(w == b"nastyword" for (n, w), x in number.items() if x in weight)
    for i, text in [*rows, (1000, None)]:
        z = sum(weight.get(x, 0.0) for x in {number[f] for f in plain_features(text)})
        below = [0.0, *(1 / (1 + np.exp(-(c - z))) for c in model.thresholds), 1.0]
        p = np.diff(below)
        assert got[i].severity == pytest.approx(sum(k * x for k, x in enumerate(p))) and got[i].p_toxic == pytest.approx(1 - p[0])
    severe = [got[i].severity for i in range(0, 600, 5)]
    assert np.std(severe) > 0.01
    wide = spark.createDataFrame([(9, "hatefulthing " + "wordy " * 300000)], SCHEMA)
    assert toxicity.score(wide, model).first().severity == pytest.approx(toxicity.score(spark.createDataFrame([(9, "hatefulthing wordy")], SCHEMA), model).first().severity)
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not got[i].toxic for i in range(600)) + 3
    nothing = toxicity.fit(docs, known.limit(0))
    assert not any(r.toxic for r in toxicity.score(docs, nothing).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0
