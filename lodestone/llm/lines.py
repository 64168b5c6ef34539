"""Operator 10: line dedup by a segment-partition edit join, with SQL functions only.

Equal lines of any length are one class, but for blank ones (ASCII white space alone), which all stay. Lines that are
near each other link too: LEVELS say from which length on (UTF-8 bytes of the shorter line) how many edits (of bytes)
are allowed. For lines that differ by at most e, one of e + 1 even segments of the shorter (or equally long) line stands
unchanged in the other, at a place that the two lengths and the segment's number bound: every line indexes its segments
under its length, and probes the substrings that the index of each length up to e less could hold. What meets there is
verified by banded bit-parallel edit distance (a band of 2 e + 1 diagonals held in the bits of one number). Of each
connected group of lines the first occurrence by id and line number stays (null ids come last), all others go.

A null text stays null, an empty one empty. Rows that repeat an id and text are one document, each returned alike. A
text loses lines only; all columns are kept, whatever their names: a made column whose name is taken gets underscores
behind it. An empty table gives no rows. Lines are equal where two 64-bit hashes are; numbers made with the table of
distinct lines tell them apart in links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.cluster import likely_in, linked_components, shared_buckets, tasks_of, with_component
from lodestone.shared import Scratch, free_names

#: (bytes of the shorter line from which on, edits)
LEVELS = ((40, 1), (80, 2), (160, 3))
#: Fixed value: a line that has this is not blank.
INK = r"[^\x09-\x0D\x20]"


def edits_sql(n: str, levels: tuple = LEVELS) -> str:
    """SQL of the edits allowed at a length."""
    whens = " ".join(f"WHEN {n} >= {low} THEN {e}" for low, e in sorted(levels, reverse=True))
    return f"(CASE {whens} ELSE 0 END)" if levels else "0"


def segment_places(edits: int) -> list[tuple[int, int, int, int]]:
    """(bytes less, segment from 1, shift, whether it is a probe only) of every key of a line."""
    out = []
    for less in range(edits + 1):
        for i in range(1, edits + 2):
            left, right = max(-(i - 1), less - (edits + 1 - i)), min(i - 1, less + (edits + 1 - i))
            out += [(less, i, shift, int(less > 0 or shift != 0)) for shift in range(left, right + 1)]
    return out


def segment_keys(kinds: DataFrame, levels: tuple, probes: bool) -> DataFrame:
    """key, id, n: each line's probes, or its indexed segments (rows of node, line binary), for lines that levels allow an edit.

    One short expression over a table of places, rather than a long one a place, so that it stays compiled; the table is that
    of the line's length, so that all levels take one pass.
    """
    levels = sorted(levels)
    spans = [(e, low, levels[k + 1][0] if k + 1 < len(levels) else 1 << 30) for k, (low, e) in enumerate(levels)]
    places = lambda e, low, high: [f"struct({less} as less, {i} as i, {shift} as shift, {e + 1} as parts, {low} as low, {high} as high)" for less, i, shift, probe in segment_places(e) if probe == probes]
    whens = []
    # A line of a level's last lengths and some edits more probes that level too.
    for bound in sorted({low for _, low, _ in spans} | {high + e for e, _, high in spans}, reverse=True):
        own = [x for e, low, high in spans if low <= bound < high + e for x in places(e, low, high)]
        whens.append(f"WHEN n >= {bound} THEN array({', '.join(own)})" if own else "")
    rows = kinds.select("node", "line", F.octet_length("line").alias("n")).where(f"n >= {levels[0][0]}")
    rows = rows.select("node", "line", "n", F.expr(f"inline(CASE {' '.join(whens)} END)")).withColumn("size", F.expr("n - less"))
    # Segments differ by one byte at most; the last (size mod parts) ones have it.
    rows = rows.where("size >= low and size < high").withColumn("short", F.expr("cast(size div parts as int)")).withColumn("extra", F.expr("size % parts"))
    rows = rows.withColumn("long", F.expr("short + if(i > parts - extra, 1, 0)"))
    rows = rows.withColumn("start", F.expr("(i - 1) * short + greatest(i - 1 - (parts - extra), 0) + 1 + shift"))
    rows = rows.where("start >= 1 and start + long - 1 <= n")
    return rows.select(F.expr("xxhash64(size, i, substring(line, start, long))").alias("key"), F.col("node").alias("id"), "n")


def banded_sql(x: str, y: str, e: str, most: int) -> str:
    """SQL of the edit distance of two binary columns, exact up to e (SQL, `most` or less) and more than that beyond; y is not empty."""
    full, top = f"(shiftleft(1, 2 * {e} + 1) - 1)", f"(2 * {e})"
    start = f"({full} & ~(shiftleft(1, {e}) - 1))"
    # Bytes that UTF-8 never has stand before x, so that no place in the band is negative.
    pad = f"concat(unhex('{'FF' * most}'), {x})"
    match = " + ".join(f"if(substring({pad}, j + {b + most} - {e}, 1) = substring({y}, j, 1), {1 << b}, 0)" for b in range(2 * most + 1))
    d0 = f"((((p & s.vp) + s.vp) ^ s.vp) | p | s.vn) & {full}"
    hp, hn = f"((s.vn | ~(d | s.vp)) & {full})", "(d & s.vp)"
    at = f"cast(octet_length({x}) - j + {e} as int)"
    step = f"if(j + {e} <= octet_length({x}), 1 - (shiftright(d, {top}) & 1), if({at} < 0, 0, (shiftright({hp}, {at}) & 1) - (shiftright({hn}, {at}) & 1)))"
    after = f"named_struct('vp', (({hn}) | ~(shiftright(d, 1) | {hp})) & {full}, 'vn', shiftright(d, 1) & {hp}, 'e', s.e + {step})"
    # Arrays of one element name p (the column's matches) and d (where the diagonal has no edit).
    body = f"transform(transform(array(({match}) & {full}), p -> {d0}), d -> {after})[0]"
    return f"aggregate(sequence(1, cast(octet_length({y}) as int)), named_struct('vp', {start}, 'vn', 0, 'e', least({e}, octet_length({x}))), (s, j) -> {body}, s -> s.e)"


BLOCKS = 16
#: Middles of so many bytes go to the banded distance at once.
SHORT = 24


def blocks_stand(x: str, y: str, edits: str) -> str:
    """SQL of whether enough of x's even blocks stand in y near their places: an edit spoils one of them at most.

    A loop over a short expression: a long one would make a join's method too large to be compiled.
    """
    block = f"substring({x}, k * v.z + 1, if(k < {BLOCKS - 1}, v.z, octet_length({x})))"
    near = f"substring({y}, greatest(1, k * v.z + 1 - v.e), if(k < {BLOCKS - 1}, v.z, octet_length({x})) + 2 * v.e)"
    walk = f"aggregate(array({', '.join(map(str, range(BLOCKS)))}), 0, (a, k) -> if(contains({near}, {block}), a + 1, a))"
    return f"transform(array(named_struct('z', cast(octet_length({x}) div {BLOCKS} as int), 'e', {edits})), v -> {walk} >= {BLOCKS} - v.e)[0]"


def within_edits(x: str, y: str, e: str, most: int) -> str:
    """SQL of whether two binary columns differ by at most e edits: what they have in common at both ends changes nothing
    and is left out (found by powers of two, the largest first), a long rest is tried by its blocks, and the rest goes
    through the banded distance."""
    nx, ny = f"octet_length({x})", f"octet_length({y})"
    powers = f"transform(sequence(cast(log2(greatest(1, least({nx}, {ny}))) as int), 0, -1), k -> shiftleft(1, k))"
    front = f"aggregate({powers}, 0, (a, k) -> if(a + k <= least({nx}, {ny}) and substring({x}, a + 1, k) = substring({y}, a + 1, k), a + k, a))"
    back = f"aggregate({powers}, 0, (a, k) -> if(a + k <= least({nx}, {ny}) - f and substring({x}, {nx} - a - k + 1, k) = substring({y}, {ny} - a - k + 1, k), a + k, a))"
    rest = f"named_struct('x', substring({x}, g.f + 1, {nx} - g.f - g.b), 'y', substring({y}, g.f + 1, {ny} - g.f - g.b), 'e', {e})"
    walk = f"(least(octet_length(w.x), octet_length(w.y)) <= {SHORT} or {blocks_stand('w.x', 'w.y', 'w.e')}) and {banded_sql('w.x', 'w.y', 'w.e', most)} <= w.e"
    test = f"if(abs({nx} - {ny}) > w.e, false, octet_length(w.x) = 0 or octet_length(w.y) = 0 or ({walk}))"
    return f"transform(transform(transform(array({front}), f -> named_struct('f', f, 'b', {back})), g -> {rest}), w -> {test})[0]"


def near_lines(kinds: DataFrame, levels: tuple, scratch: Scratch) -> DataFrame:
    """Components (node, component) of the links among distinct lines (node, line binary)."""
    keys = lambda probes: segment_keys(kinds, levels, probes)
    shared = shared_buckets(keys(False), scratch, keys(True), kinds.count() * (max(e for _, e in levels) + 1))
    wanted = scratch.save(shared.select("id").distinct())
    # An inner join: the optimiser would push a semi join below the bitmap's, and shuffle every line.
    texts = likely_in(kinds.select(F.col("node").alias("id"), "line"), "id", wanted, "id").join(wanted, "id")
    # An edit changes at most two counts of bytes and four of byte pairs; the parities of 64 classes are the bits of a number.
    parity = lambda q: f"aggregate(sequence(1, cast(octet_length(line) - {q - 1} as int)), 0L, (s, i) -> s ^ shiftleft(1L, cast(xxhash64(substring(line, i, {q})) & 63 as int)))"
    # Lines stand in a structure, as a condition copies every plain column of bytes that it names for each pair.
    texts = scratch.save(texts.select("id", F.octet_length("line").alias("n"), F.struct("line").alias("t"), F.expr(parity(1)).alias("ones"), F.expr(parity(2)).alias("twos")))
    alike = lambda n, m: f"abs({n} - {m}) <= {edits_sql(f'least({n}, {m})', levels)}"

    allowed = lambda x, y: edits_sql(f"least({x}.n, {y}.n)", levels)

    def close(x: str, y: str) -> str:
        """SQL of whether two rows of n, ones and twos may link."""
        return f"bit_count({x}.ones ^ {y}.ones) <= 2 * {allowed(x, y)} and bit_count({x}.twos ^ {y}.twos) <= 4 * {allowed(x, y)}"

    def link(x: str, y: str) -> str:
        """SQL of whether two rows of n, t.line link."""
        return within_edits(f"{x}.t.line", f"{y}.t.line", allowed(x, y), max(e for _, e in levels))

    def verified(pairs: DataFrame) -> DataFrame:
        side = lambda c, name: texts.select(F.col("id").alias(c), F.struct("n", "t", "ones", "twos").alias(name))
        one = pairs.join(side("a", "x"), "a").repartition(tasks_of(pairs), "b")
        return one.join(side("b", "y"), "b").where(f"{close('x', 'y')} and {link('x', 'y')}").select("a", "b")

    return linked_components(shared, alike, verified, scratch, profile=texts.drop("n"), close=close("p", "m"), link=link("p", "m"))


def dedup_lines(df: DataFrame, levels: tuple = LEVELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with text rid of lines that stand elsewhere before, and n_lines, n_removed."""
    scratch = Scratch(df.sparkSession)
    n_lines, n_removed, of_id, of_text, gone_at, n_gone = free_names(df.columns, "n_lines", "n_removed", "_id", "_th", "_gone", "_n_gone")
    own_id, own_text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = df.select(own_id.alias("id"), own_text.alias("text"))
    split = rows.select("id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = split.where(F.col("line").rlike(INK)).withColumn("line", F.col("line").cast("binary"))
    lines = lines.withColumn("h", F.xxhash64("line")).withColumn("g", F.xxhash64(F.lit(1), "line"))
    slim = scratch.save(lines.select("id", "th", "pos", "h", "g"))
    classes = slim.groupBy("h", "g").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("k"))
    if levels:
        long = lines.where(F.octet_length("line") >= min(low for low, _ in levels)).select("h", "g", "line").dropDuplicates(["h", "g"])
        kinds = scratch.save(long.withColumn("node", F.monotonically_increasing_id()))
        found = near_lines(kinds, levels, scratch)
        named = kinds.select("h", "g", "node").join(found, "node").select("h", "g", "component")
        classes = classes.join(named, ["h", "g"], "left")
    else:
        classes = classes.withColumn("component", F.lit(None).cast("bigint"))
    # A class is named by its component, or by its two hashes.
    linked = F.col("component").isNotNull()
    classes = classes.select("h", "g", "id", "k", linked.alias("c0"), F.when(linked, F.col("component")).otherwise(F.col("h")).alias("c1"), F.when(linked, 0).otherwise(F.col("g")).alias("c2"))
    classes, c = scratch.save(classes), ["c0", "c1", "c2"]
    # Groups with more than one occurrence: by component, as linked classes have several lines at least.
    groups = classes.groupBy(*c).agg(F.sum("k").alias("k"), F.min("id").alias("first_id")).where("k > 1")
    of = scratch.save(classes.select("h", "g", *c).join(groups.select(*c, "first_id"), c))
    held = scratch.save(likely_in(slim, "h", of, "h").join(of, ["h", "g"]).select("id", "th", "pos", *c, "first_id"))
    scratch.keep_only(held)
    first = held.where(F.col("id").eqNullSafe(F.col("first_id"))).groupBy(*c).agg(F.min("th").alias("first_th"))
    first = held.join(first, c).where("id <=> first_id and th = first_th").groupBy(*c, "first_th").agg(F.min("pos").alias("first_pos"))
    gone = held.join(first, c).where("not (id <=> first_id and th = first_th and pos = first_pos)")
    # A byte a line up to the last one that goes ('1'), so that each line is looked up in one step however many go.
    gone = gone.groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    marks = F.expr("cast(concat(array_join(transform(at, (x, k) -> repeat('0', cast(x - if(k = 0, -1, at[greatest(k - 1, 0)]) - 1 as int))), '1'), '1') as binary)")
    gone = gone.select(F.col("id").alias(of_id), F.col("th").alias(of_text), marks.alias(gone_at), F.size("at").alias(n_gone))
    out = df.join(gone, own_id.eqNullSafe(F.col(of_id)) & (F.xxhash64(own_text) == F.col(of_text)), "left")
    kept = F.expr(f"array_join(filter(split(`{text_col}`, '\n', -1), (x, i) -> i >= octet_length({gone_at}) or substring({gone_at}, i + 1, 1) = X'30'), '\n')")
    text = F.when(F.col(gone_at).isNull(), own_text).otherwise(kept)
    count = F.when(F.coalesce(own_text, F.lit("")) == "", 0).otherwise(F.size(F.split(own_text, "\n", -1))).cast("bigint")
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    return out.select(*columns, count.alias(n_lines), F.coalesce(F.col(n_gone), F.lit(0)).cast("bigint").alias(n_removed))


ORACLE = f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, text, line, pos FROM (SELECT doc_id, text, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) - 1 pos FROM documents)),
inked AS (SELECT * FROM lines WHERE regexp_matches(line, '{INK}')),
kinds AS (SELECT line, n, k, {edits_sql('n')} AS e FROM (SELECT line, octet_length(encode(line)) n, row_number() OVER (ORDER BY line) k FROM (SELECT DISTINCT line FROM inked))),
-- One of e + 1 parts of the shorter line is unchanged; only lines that hold one are compared.
parts AS (SELECT *, list_transform(range(e + 1), lambda i: substr(line, 1 + length(line) * i // (e + 1), length(line) * (i + 1) // (e + 1) - length(line) * i // (e + 1))) AS p FROM kinds WHERE e > 0),
links AS (SELECT a.k x, b.k y FROM parts a JOIN kinds b ON b.n BETWEEN a.n AND a.n + a.e AND a.k <> b.k AND len(list_filter(a.p, lambda q: contains(b.line, q))) > 0 AND levenshtein(a.line, b.line) <= a.e),
near AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT k a, k b FROM kinds UNION SELECT r.a, n.y FROM reach r JOIN near n ON n.x = r.b),
groups AS (SELECT a k, min(b) c FROM reach GROUP BY a),
ranked AS (SELECT l.doc_id, l.pos, row_number() OVER (PARTITION BY g.c ORDER BY l.doc_id, l.pos) r FROM inked l JOIN kinds k USING (line) JOIN groups g USING (k))
SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE r.r IS NULL OR r.r = 1), '') AS text,
  CASE WHEN any_value(l.text) = '' THEN 0 ELSE count(*) END::BIGINT AS n_lines, count(*) FILTER (WHERE r.r > 1)::BIGINT AS n_removed
FROM lines l LEFT JOIN ranked r ON r.doc_id = l.doc_id AND r.pos = l.pos GROUP BY l.doc_id
"""
