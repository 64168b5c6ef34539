"""Operator 11: phrase collocations by merged count-min sketches and an exact second pass.

Texts (A-Z in lower case) are cut at PIECE_ENDS into pieces and those at blanks into words. A first pass counts words and
pairs of words in a count-min sketch a task: DEPTH rows of cells, each phrase one cell a row by its hash with the
language. Cells stop at `least`, which loses nothing, as only "at least that many" is asked. Sketches are merged by adding cells
up, and a bit a cell tells whether the sum reaches `least`. A sketch never counts less than there is, so every phrase
that is frequent has all its bits set. A second sketch counts phrases of three and four words whose pairs passed. The
exact pass then counts only what passes: words told apart as bytes, phrases by their words' numbers within a batch, as
text between batches. So the sketch's size (`cells` a row, at most MOST_CELLS, from the size of the texts) bounds memory
and what is broadcast, and decides how much the exact pass counts, not what is found.

Scoring is exact: a = f(phrase), l and r those of the two parts of a cut, floor(2000000 a / (l + r)) for the cut where
that is lowest (ties: the shortest first part), in decimals. A candidate that stands in a longer one with
100 f(longer) >= SUBSUMED a goes. Each language's first `top` are taken within salts first, so no task sorts a language.

A null language is `und`, a null text empty. Rows that repeat count each. Pieces of a long text are dealt with one
after another; a piece is handled whole, however long. Only the two columns are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.words import LOWER, Texts, gram_hashes, mix, pieces, separators, span_hashes, word_spans
from lodestone.shared import Scratch

LEAST = 30
WORDS = 4
TOP = 2000
SUBSUMED = 80
DEPTH = 4
#: Cells a row at most: of one byte each, as long as `least` is under 256.
MOST_CELLS = 1 << 24
LEAST_CELLS = 1 << 16
#: Cells of a row that travel together.
CHUNK = 1 << 14
WINDOW_BYTES = 1 << 20
PIECE_ENDS = separators([(0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F), (0x0A, 0x0D)])
GAPS = PIECE_ENDS | separators([(0x20, 0x20), (0x09, 0x09)])


class Sketch:
    """A count-min sketch whose cells stop at `least`."""

    def __init__(self, cells: int, least: int):
        self.cells, self.least = cells, least
        self.counts = np.zeros((DEPTH, cells), np.min_scalar_type(least))

    def add(self, hashes: np.ndarray) -> None:
        kinds, n = np.unique(hashes, return_counts=True)
        for row in range(DEPTH):
            at = places(kinds, row, self.cells)
            order = np.argsort(at)
            at, first = np.unique(at[order], return_index=True)
            if len(at):
                more = np.add.reduceat(n[order], first)
                self.counts[row, at] = np.minimum(self.counts[row, at] + more, self.least)

    def chunks(self) -> Iterator[tuple[int, bytes]]:
        step = min(CHUNK, self.cells)
        for row in range(DEPTH):
            for i in range(0, self.cells, step):
                part = self.counts[row, i : i + step]
                if part.any():
                    yield (row * self.cells + i) // step, part.tobytes()


def places(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    return (mix(hashes, 50 + row) & np.uint64(cells - 1)).astype(np.int64)


class Filter:
    """Bits of cells that reach `least`: whether a phrase may be frequent (never no for one that is)."""

    def __init__(self, cells: int, chunks: dict[int, bytes]):
        self.cells, step = cells, min(CHUNK, cells)
        self.bits = np.zeros(DEPTH * cells // 8, np.uint8)
        for k, bits in chunks.items():
            self.bits[k * step // 8 : (k + 1) * step // 8] = np.frombuffer(bits, np.uint8)

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row in range(DEPTH):
            live = np.flatnonzero(out)
            at = places(hashes[live], row, self.cells) + row * self.cells
            out[live] = (self.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
        return out


class Words:
    """The words of some texts: numbers by distinct word, hashes, and which word goes on to the next in its piece."""

    def __init__(self, texts: Texts, langs: pa.Array):
        starts, ends, first = word_spans(texts, GAPS)
        kept, n = LOWER[texts.data[~GAPS[texts.data]]], len(starts)
        offsets = np.concatenate(([0], np.cumsum(ends - starts)))
        words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))]).dictionary_encode()
        self.words, self.ids = words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        known = Texts(self.words)
        self.hashes = span_hashes(known, known.offsets[:-1], known.offsets[1:], lower=False)[self.ids]
        piece = np.cumsum(PIECE_ENDS[texts.data], dtype=np.int32)[starts] if n else np.zeros(0, np.int32)
        goes_on = np.zeros(n, bool)
        goes_on[:-1] = piece[:-1] == piece[1:]
        last = first[1:] - 1
        goes_on[last[np.diff(first) > 0]] = False
        self.goes_on = goes_on
        coded = langs.dictionary_encode()
        self.langs = coded.dictionary
        spoken = Texts(self.langs)
        of_text = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.lang = np.repeat(of_text, np.diff(first))
        self.salt = mix(span_hashes(spoken, spoken.offsets[:-1], spoken.offsets[1:], lower=False), 9)[self.lang]

    def grams(self, k: int) -> np.ndarray:
        """Where k words stand in a row within a piece."""
        ok = np.ones(max(0, len(self.ids) - k + 1), bool)
        for i in range(k - 1):
            ok &= self.goes_on[i : i + len(ok)]
        return np.flatnonzero(ok)

    def keys(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k words from each place on, with their language."""
        return gram_hashes(self.hashes, at, k) ^ self.salt[at] ^ np.uint64(k)

    def pairs_pass(self, seen: Filter) -> np.ndarray:
        """For each word whether the pair from it on may be frequent."""
        out = np.zeros(len(self.ids), bool)
        at = self.grams(2)
        out[at] = seen.passes(self.keys(at, 2))
        return out


def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """Of rows lang, text: all texts in windows of some MB; longer texts are cut behind a piece's end."""
    for batch in pieces(batches, limit=WINDOW_BYTES):
        texts = Texts(batch.column("text"))
        langs = batch.column("lang")
        if len(texts.data) <= 2 * WINDOW_BYTES:
            yield Words(texts, langs)
            continue
        for i in range(len(texts)):
            low, high = int(texts.offsets[i]), int(texts.offsets[i + 1])
            while low < high:
                stop = min(high, low + WINDOW_BYTES)
                while stop < high:
                    ends = np.flatnonzero(PIECE_ENDS[texts.data[stop - 1 : stop - 1 + WINDOW_BYTES]])
                    stop = min(high, stop + (int(ends[0]) if len(ends) else WINDOW_BYTES))
                    if len(ends):
                        break
                part = Texts(pa.array([], pa.string()))
                part.data, part.offsets = texts.data[low:stop], np.array([0, stop - low], np.int64)
                yield Words(part, langs.slice(i, 1))
                low = stop


def merged(rows: DataFrame, cells: int, least: int, hashes) -> Filter:
    """The filter of the merged sketches of `hashes(window)` over all windows of rows lang, text."""
    step, kind = min(CHUNK, cells), np.min_scalar_type(least)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sketch(cells, least)
        for window in windows(batches):
            out.add(hashes(window))
        for k, part in out.chunks():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part], pa.binary())], names=["chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by chunk; one chunk's sums are held at a time."""
        now, sums = None, None
        bits = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], names=["chunk", "bits"])
        for batch in batches:
            for k, part in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
                if k != now:
                    if now is not None and (sums >= least).any():
                        yield bits()
                    now, sums = k, np.zeros(step, np.int64)
                sums = np.minimum(sums + np.frombuffer(part.as_buffer(), kind), least)
        if now is not None and (sums >= least).any():
            yield bits()

    context = rows.sparkSession.sparkContext
    parts = rows.coalesce(max(1, context.defaultParallelism)).mapInArrow(sketch, "chunk int, counts binary")
    dealt = parts.repartition(max(1, context.defaultParallelism), "chunk").sortWithinPartitions("chunk")
    # DEPTH * cells bits at most, whatever the rows.
    return Filter(cells, {r["chunk"]: bytes(r["bits"]) for r in dealt.mapInArrow(add, "chunk int, bits binary").toLocalIterator()})


def frequent(rows: DataFrame, least: int, cells: int) -> DataFrame:
    """lang, k, phrase, f of all phrases of 1 to WORDS words that come up `least` times or more; k = 0 has all words' count."""
    context = rows.sparkSession.sparkContext
    short = context.broadcast(merged(rows, cells, least, lambda w: np.concatenate([w.keys(w.grams(k), k) for k in (1, 2)])))

    def longer(w: Words) -> np.ndarray:
        pair = w.pairs_pass(short.value)
        out = []
        for k in range(3, WORDS + 1):
            at = w.grams(k)
            for i in range(k - 1):
                at = at[pair[at + i]]
            out.append(w.keys(at, k))
        return np.concatenate(out)

    long = context.broadcast(merged(rows, cells, least, longer))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w in windows(batches):
            size = max(1, len(w.words))
            totals = np.bincount(w.lang, minlength=len(w.langs))
            yield _rows(w.langs, np.arange(len(totals)), 0, pa.array([""] * len(totals), pa.string()), totals)
            text = w.words.cast(pa.large_string())
            # Names of the phrases from each word on, -1 where none passes: pairs of the name one word shorter and a word.
            name = np.full(len(w.ids), -1, np.int64)
            live = np.flatnonzero(short.value.passes(w.keys(np.arange(len(w.ids)), 1)))
            key = w.lang[live] * size + w.ids[live]
            for k in range(1, WORDS + 1):
                kinds, first, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                at = live[first]
                words = [text.take(pa.array(w.ids[at + i])) for i in range(k)]
                yield _rows(w.langs, w.lang[at], k, (pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if k > 1 else words[0]).cast(pa.string()), n)
                if k == WORDS:
                    break
                name[:] = -1
                name[live] = inverse
                at = w.grams(k + 1)
                at = at[(name[at] >= 0) & (name[at + 1] >= 0)]
                live = at[(short if k == 1 else long).value.passes(w.keys(at, k + 1))]
                key = name[live] * size + w.ids[live + k]

    found = rows.mapInArrow(count, "lang string, k int, phrase string, n bigint")
    return found.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("f")).where(f"k = 0 or f >= {least}")


def _rows(langs: pa.Array, lang: np.ndarray, k: int, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs.take(pa.array(lang)).cast(pa.string()), pa.array(np.full(len(n), k, np.int32)), phrase, pa.array(n, pa.int64())], names=["lang", "k", "phrase", "n"])


def scored(counts: DataFrame) -> DataFrame:
    """Of frequent phrases lang, k, phrase, f: every candidate with a, l, r and score of its lowest cut, and n."""
    parts = F.expr("inline(transform(sequence(1, k - 1), j -> struct(j as cut, substring_index(phrase, ' ', j) as head, substring_index(phrase, ' ', j - k) as tail)))")
    cuts = counts.where("k >= 2").select("lang", "k", "phrase", F.col("f").alias("a"), parts)
    part = lambda name, f: counts.where("k >= 1").select(F.col("lang").alias(f"{name}_lang"), F.col("phrase").alias(f"{name}_phrase"), F.col("f").alias(f))
    cuts = cuts.join(part("_h", "l"), F.expr("lang = _h_lang and head = _h_phrase")).join(part("_t", "r"), F.expr("lang = _t_lang and tail = _t_phrase"))
    cuts = cuts.withColumn("score", F.expr("cast((cast(a as decimal(19,0)) * 2000000) div (cast(l as decimal(20,0)) + r) as bigint)"))
    best = cuts.groupBy("lang", "phrase").agg(F.first("k").alias("k"), F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    totals = counts.where("k = 0").select(F.col("lang").alias("_n_lang"), F.col("f").alias("n"))
    return best.select("lang", "k", "phrase", "a", "s.l", "s.r", "s.score").join(totals, F.expr("lang = _n_lang")).drop("_n_lang")


def unsubsumed(candidates: DataFrame, percent: int = SUBSUMED) -> DataFrame:
    """Candidates (lang, k, phrase, a) that stand in no longer one of nearly as many occurrences."""
    inner = F.expr("explode(flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' ')))))")
    inside = candidates.where("k > 2").select(F.col("lang").alias("_in_lang"), F.col("a").alias("_in_a"), inner.alias("_in"))
    most = inside.groupBy("_in_lang", "_in").agg(F.max("_in_a").alias("_most"))
    joined = candidates.join(most, F.expr("lang = _in_lang and phrase = _in"), "left")
    return joined.where(f"_most is null or cast(_most as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * {percent}").drop("_in_lang", "_in", "_most")


def first_of_each(df: DataFrame, top: int, salts: int) -> DataFrame:
    """Each language's first `top` by score, a and phrase, with their rank: first within salts, then among those left."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    inner = F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))
    some = df.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("_n", inner).where(F.col("_n") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")
    return some.withColumn("rank", rank).where(F.col("rank") <= top).drop("_salt", "_n")


def cells_for(n_bytes: int) -> int:
    """Cells a row for so many bytes of text: about one for every eight, within the bounds."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << max(0, n_bytes // 8).bit_length()))


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, cells: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score."""
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    if cells is None:
        cells = cells_for(rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0)
    counts = scratch.save(frequent(rows, least, cells))
    candidates = scratch.save(scored(counts))
    salts = max(8, candidates.count() // (4 * top))
    out = first_of_each(unsubsumed(candidates), top, salts)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = rf"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS p, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
grams AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM lists, range(1, {WORDS + 1}) t(k) WHERE len(w) >= k),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= {LEAST}),
cuts AS (SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM counts WHERE k >= 2),
scores AS (SELECT c.*, h.f AS l, t.f AS r, ((2000000::HUGEINT * a) // (h.f + t.f))::BIGINT AS score FROM cuts c
  JOIN counts h ON h.lang = c.lang AND h.phrase = array_to_string(w[1:cut], ' ') JOIN counts t ON t.lang = c.lang AND t.phrase = array_to_string(w[cut + 1:c.k], ' ')),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM lowest, range(2, {WORDS}) x(m), range(1, {WORDS}) y(i) WHERE m < k AND i + m - 1 <= k),
most AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
kept AS (SELECT s.* FROM lowest s LEFT JOIN most m ON m.lang = s.lang AND m.phrase = s.phrase WHERE m.most IS NULL OR 100::HUGEINT * m.most < {SUBSUMED}::HUGEINT * s.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
QUALIFY rank <= {TOP}
"""
