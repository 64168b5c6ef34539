"""Operator 8: license scans by diagonal voting.

Templates (names, and the public texts and notices of licence_texts.txt) are cut into rolling word k-gram hashes with
their positions, a table bounded by the templates; all rolling k-gram hashes of all texts are joined to it. A hit at text
position p and template position q votes for the diagonal p - q. Votes are gathered by text, template and diagonal;
neighbouring diagonals (a few words inserted or left out) are merged. A span is a candidate where the votes come from
VOTES of the template's k-grams; it is then verified on the words themselves: a name must stand there word by word, of a
notice the longest common run of words in order (a subsequence) must hold COVER of its words. Where verified notices
overlap, the one with the most words stands, so that a text under one licence isn't labelled with its likes.

A null or empty text has no words and score 0. Repeated rows are scanned each and come out alike; rows of one id with
different texts are kept apart by their texts. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.cluster import likely_in
from lodestone.llm.words import LOWER, NON_ALNUM, Texts, gram_hashes, pieces, runs, span_hashes, word_spans
from lodestone.shared import Scratch

K = 3

# Names to be found word by word, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

VOTES = 0.3
COVER = 0.6
DRIFT = 4
_DOC = -1

Template = tuple[str, str, bool]


def notices() -> list[tuple[str, str]]:
    """(label, text) of the texts and notices that ship with the package."""
    out: list[tuple[str, list[str]]] = []
    for line in resources.files("lodestone.llm").joinpath("licence_texts.txt").read_text("utf-8").splitlines():
        if line.startswith("== "):
            out.append((line[3:].strip(), []))
        elif out:
            out[-1][1].append(line)
    return [(label, "\n".join(lines)) for label, lines in out]


def templates_of(phrases=PHRASES, texts: list[tuple[str, str]] | None = None) -> list[Template]:
    """(text, label, whether it must be found whole)."""
    return [(p, label, True) for p, label in phrases] + [(t, label, False) for label, t in (notices() if texts is None else texts)]


def split_words(column: pa.Array) -> list[list[bytes]]:
    """Each text's words in lower case (A-Z)."""
    texts = Texts(column)
    starts, ends, first = word_spans(texts, NON_ALNUM)
    data = LOWER[texts.data].tobytes() if len(texts.data) else b""
    flat = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return [flat[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    texts = Texts(column)
    starts, ends, first = word_spans(texts, NON_ALNUM)
    hashes = span_hashes(texts, starts, ends)
    at, counts = runs(first, K)
    return gram_hashes(hashes, at, K).view(np.int64), counts, np.diff(first)


def template_table(templates: list[Template]) -> list[tuple[int, int, int, int, bool]]:
    """hash, template, position, the template's k-grams, whether it must be found whole."""
    out = []
    for t, (text, _, whole) in enumerate(templates):
        grams, _, _ = _grams(pa.array([text]))
        if not len(grams):
            raise ValueError(f"a template needs {K} words: {text!r}")
        out += [(int(g), t, q, len(grams), whole) for q, g in enumerate(grams)]
    return out


def common_words(template: dict[bytes, int], size: int, window: list[bytes]) -> int:
    """Length of the longest common subsequence of a window and a template given as each word's positions in bits."""
    full = (1 << size) - 1
    v = full
    for w in window:
        m = template.get(w, 0)
        v = ((v + (v & m)) | (v & ~m)) & full
    return size - v.bit_count()


def _masks(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


FOUND = "n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,cover:double>>"


def verify(words: list[bytes], candidates: list[tuple[int, int, int, int, int]], templates: list[tuple[list[bytes], dict[bytes, int], str, bool]]) -> tuple:
    """The values of FOUND of one text's candidates (template, lowest and highest diagonal, first and last hit)."""
    base, near, score = [], [], 0.0
    for t, low, high, first, last in candidates:
        own, masks, label, whole = templates[t]
        if whole:
            if words[low : low + len(own)] == own:
                base.append((low, label))
        else:
            slack = max(DRIFT, len(own) // 10)
            matched = common_words(masks, len(own), words[max(0, low - slack) : high + len(own) + slack])
            cover = matched / len(own)
            score = max(score, cover)
            if cover >= COVER:
                near.append((matched, cover, first, last + K, label))
    taken: list[tuple] = []
    for span in sorted(near, key=lambda x: (-x[0], -x[1], x[2], x[4])):
        if all(span[4] == x[4] or span[3] <= x[2] or x[3] <= span[2] for x in taken):
            taken.append(span)
    names = sorted({label for _, label in base})
    spans = sorted([(label, a, a + len(w), 1.0) for a, label in base for w in [next(o for o, _, name, whole in templates if whole and name == label)]] + [(x[4], x[2], x[3], x[1]) for x in taken], key=lambda x: (x[1], x[0]))
    starts = [a for a, _ in base]
    return len(base), min(starts, default=None), max(starts, default=None), ",".join(names), ",".join(sorted({*names, *(x[4] for x in taken)})), 1.0 if base else score, spans


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[Template] | None = None) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans: label, start and end word, cover."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    spark, templates = df.sparkSession, templates_of() if templates is None else templates
    scratch = Scratch(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId() << 33, 0
        for batch in pieces(batches):
            grams, counts, words = _grams(batch.column("text"))
            n = len(counts)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(grams))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(task + done + np.arange(n)), pa.array(words), lists], names=["id", "th", "row", "n_words", "grams"])
            done += n

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("th", F.xxhash64("text"))
    kind = rows.schema["id"].dataType.simpleString()
    hashed = rows.mapInArrow(work, f"id {kind}, th bigint, row bigint, n_words bigint, grams array<bigint>")
    # A position of its own for each text, so that texts without hits keep a row.
    table = spark.createDataFrame([*template_table(templates), (0, _DOC, 0, 0, False)], "gram bigint, template int, q int, size int, whole boolean")
    every = hashed.select("id", "th", "row", "n_words", F.posexplode(F.array_insert("grams", 1, F.lit(0).cast("bigint"))).alias("p", "gram"))
    hits = every.join(F.broadcast(table), "gram").where("(template = -1) = (p = 0)")
    text = ["row", "id", "th", "n_words"]
    votes = hits.groupBy(*text, "template", "whole", "size", F.expr("p - 1 - q").alias("diagonal")).agg(F.collect_set("q").alias("qs"), F.min("p").alias("low"), F.max("p").alias("high"))
    line = Window.partitionBy("row", "template").orderBy("diagonal")
    votes = votes.withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > F.when(F.col("whole"), 0).otherwise(DRIFT)).cast("int"), F.lit(1)))
    votes = votes.withColumn("band", F.sum("new").over(line))
    spans = votes.groupBy(*text, "template", "whole", "size", "band").agg(F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("n"), F.min("diagonal").alias("first"), F.max("diagonal").alias("last"), (F.min("low") - 1).alias("low"), (F.max("high") - 1).alias("high"))
    good = F.expr(f"template >= 0 and if(whole, n = size, n >= {VOTES} * size)")
    candidate = F.when(good, F.struct("template", "first", "last", "low", "high"))
    found = scratch.save(spans.groupBy(*text).agg(F.sort_array(F.collect_list(candidate)).alias("c")).drop("row"))

    some = scratch.save(found.where("size(c) > 0").dropDuplicates(["id", "th"]).select(F.col("id").alias("i"), F.col("th").alias("t"), "c"))
    whole = likely_in(rows, "th", some, "t").join(some, F.expr("id <=> i and th = t")).dropDuplicates(["id", "th"]).select("id", "th", "text", "c")
    own = [(w, _masks(w), label, must) for (_, label, must), w in zip(templates, split_words(pa.array([x[0] for x in templates])), strict=True)]
    schema = to_arrow_schema(_parse_datatype_string(FOUND))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            lists = [[tuple(x.values()) for x in c] for c in batch.column("c").to_pylist()]
            results = [verify(w, c, own) for w, c in zip(split_words(batch.column("text")), lists, strict=True)]
            arrays = [pa.array([[dict(zip(("label", "start", "end", "cover"), s, strict=True)) for s in v] for v in column] if f.name == "spans" else list(column), f.type) for f, column in zip(schema, zip(*results, strict=True), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), *arrays], names=["i", "t", *schema.names])

    seen = scratch.save(whole.mapInArrow(check, f"i {kind}, t bigint, {FOUND}"))
    scratch.keep_only(found, seen)
    out = found.join(seen, F.expr("id <=> i and th = t"), "left")
    none = {"n_base": F.lit(0).cast("bigint"), "base_labels": F.lit(""), "labels": F.lit(""), "score": F.lit(0.0), "spans": F.array().cast(seen.schema["spans"].dataType)}
    columns = [F.coalesce(F.col(c), none[c]).alias(c) if c in none else F.col(c) for c in schema.names]
    return out.select("id", "n_words", *columns).withColumnRenamed("id", id_col)
