"""Line dedup by a deletion-neighbourhood join, in DataFrame operations only.

Lines are compared as lists of words, A-Z in lower case. A line goes if an
earlier line (by doc_id, then place) is equal, or, where both have
``min_words`` words at least, is one edit away: one word put in, left out or
replaced. All lines are judged on the input. Blank lines stay.

With ``min_chars`` two more edits count, among lines of so many characters at
least, spaces left out: a line goes if an earlier one differs in nothing but
where its spaces stand, or, where both have fewer than ``MIN_WORDS`` words, in
one character put in, left out or replaced. So scripts without spaces, split
words and short lines have near copies too. The oracle states the edits of
words only, so the registered query leaves ``min_chars`` out.

Two lines one edit apart give an equal list when the right word is deleted
from one or both. Every line's variants are therefore emitted as hashed
keys, equal keys are joined, the edit is verified on the words themselves,
and the earliest line is kept. Since one edit leaves one half of a line as
it is, only lines that share a half with another line emit variants, and
only of the other half: no other variant can meet its like.

A null text stays null and has no lines. Documents with one doc_id are
ordered by a hash of their text; equal rows are judged alike. A null doc_id
comes last. Extra columns are kept by ``deduplicate`` and may be named
anything but ``_ld_...``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, lower_az_col, small_or_merged

MIN_WORDS = 8
#: What the pipeline takes: one word in four, one character in eight.
SHORT = {"min_words": 4, "min_chars": 8}
_LAST = (1 << 63) - 1
_PLACE = ["key", "row", "ln"]


def line_words(line: Column) -> Column:
    return F.filter(F.split(lower_az_col(line), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def line_chars(line: Column) -> Column:
    return F.split(F.array_join(line_words(line), ""), "")


def _keyed(docs: DataFrame) -> DataFrame:
    """key orders documents, row tells apart those with one key."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    return docs.select(key.alias("key"), F.xxhash64("text").alias("row"), "text").filter("text IS NOT NULL")


def _place() -> Column:
    return F.struct(*_PLACE)


def _lines_of(texts: DataFrame, places: DataFrame, units: Callable[[Column], Column] = line_words) -> DataFrame:
    """key, row, ln, words (or other units) of the given places, ``places`` being checkpointed.

    Few places go to the texts; else texts and places meet by document.
    """
    if places.count() <= BROADCAST_ROWS:
        lines = texts.select("key", "row", F.posexplode(F.split("text", "\n")).alias("ln", "line")).join(F.broadcast(places), _PLACE, "left_semi")
        return lines.select(*_PLACE, units(F.col("line")).alias("words"))
    wanted = places.groupBy("key", "row").agg(F.collect_set("ln").alias("lns"))
    # generated as one row: the text is split once, not once for each line taken
    split = texts.join(wanted.hint("merge"), ["key", "row"]).select("key", "row", "lns", F.explode(F.array(F.split("text", "\n"))).alias("lines"))
    taken = split.select("key", "row", F.explode(F.transform("lns", lambda n: F.struct(n.alias("ln"), F.element_at("lines", n + 1).alias("line")))).alias("x"))
    return taken.select("key", "row", "x.ln", units(F.col("x.line")).alias("words"))


def _without(words: Column, j: Column) -> Column:
    return F.concat(F.slice(words, 1, j), F.slice(words, j + 2, F.size(words)))


def _sides(n: Column, part: Callable[[Column, Column], Column]) -> Column:
    """Hashed halves of a line of n units; ``part(at, size)`` gives size units from at (from 1). Lines one edit apart share one."""
    half = lambda side, size, x: F.xxhash64(F.lit(side), size, x)
    short, long = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    tails = [n - long, (n - 1) - short]
    keys = [half("P", short, part(F.lit(1), short)), half("P", long, part(F.lit(1), long)), *(half("S", t, part(n - t + 1, t)) for t in tails)]
    return F.array_distinct(F.array(*keys))


def removed_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, min_chars: int | None = None) -> DataFrame:
    """key, row, ln (from 0), near (one edit away, not equal) of every line that goes."""
    if min_words < 2:
        raise ValueError("min_words must be 2 at least")
    if min_chars is not None and min_chars < 2:
        raise ValueError("min_chars must be 2 at least")
    texts = _keyed(docs)
    occ = texts.select("key", "row", F.posexplode(F.split("text", "\n")).alias("ln", "line")).select(*_PLACE, F.explode(F.array(line_words(F.col("line")))).alias("words"))
    occ = occ.filter(F.size("words") > 0).select(*_PLACE, F.size("words").alias("n"), "words", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(7), "words").alias("h2"))

    # equal lines: a row a line, partly grouped before the shuffle
    n = F.col("n")
    sides = {"halves": F.when(n >= min_words, _sides(n, lambda at, size: F.slice("words", at, size)))}
    if min_chars is not None:
        occ = occ.select("*", F.explode(F.array(F.array_join("words", ""))).alias("solid"))
        c, solid = F.length("solid"), F.col("solid")
        sides["flat"] = F.when(c >= min_chars, F.struct(F.xxhash64(solid).alias("f1"), F.xxhash64(F.lit(7), solid).alias("f2")))
        sides["char_halves"] = F.when((c >= min_chars) & (n < MIN_WORDS), _sides(c, lambda at, size: F.substring(solid, at, size)))
    # the words are looked at once; what is needed of each line is a few numbers
    slim = cut(occ.select(*_PLACE, "h1", "h2", *(x.alias(name) for name, x in sides.items())))
    first = cut(slim.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("copies"), *(F.max(name).alias(name) for name in sides)))
    repeated = first.filter("copies > 1").select("h1", "h2", "first")
    equal = slim.select(*_PLACE, "h1", "h2").join(small_or_merged(repeated), ["h1", "h2"]).filter(_place() > F.col("first"))
    gone = [equal.select(*_PLACE, F.lit(False).alias("near"))]

    halves = first.filter("halves IS NOT NULL").select("h1", F.col("first.*"), F.explode("halves").alias("half"))
    gone.append(_one_edit(texts, halves, min_words))
    if min_chars is not None:
        # equal but for spaces, by the same minima; the first of them stands for the others among the short lines
        solids = first.filter("flat IS NOT NULL").select("h1", "first", "flat", "char_halves")
        many = cut(solids.groupBy("flat").agg(F.min("first").alias("least"), F.count("*").alias("c")).filter("c > 1"))
        gone.append(solids.join(small_or_merged(many), "flat").filter("first > least").select("first.*", F.lit(True).alias("near")))
        short = solids.filter("char_halves IS NOT NULL").groupBy("flat").agg(F.min("first").alias("first"), F.max("char_halves").alias("halves"))
        halves = short.select(F.col("flat.f1").alias("h1"), F.col("first.*"), F.explode("halves").alias("half"))
        gone.append(_one_edit(texts, halves, min_chars, line_chars))
    return reduce(DataFrame.union, gone).groupBy(*_PLACE).agg(F.bool_and("near").alias("near"))


def _one_edit(texts: DataFrame, halves: DataFrame, least_units: int, units: Callable[[Column], Column] = line_words) -> DataFrame:
    """Places, with near, of the lines in ``halves`` (h1, the place, half) one edit of a unit away from an earlier one there."""
    # lines that share a half with another line
    shared = cut(halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a < b").select("half"))
    candidates = cut(halves.join(small_or_merged(shared), "half").select(*_PLACE).distinct())

    # their variants; each word's hash is taken with its place before and after a deletion
    lines = cut(_lines_of(texts, candidates, units))
    each = lines.select(*_PLACE, F.size("words").alias("n"), F.posexplode("words").alias("j", "word"))
    each = each.withColumn("t", F.xxhash64("word", "j")).withColumn("u", F.xxhash64("word", F.col("j") - 1))
    whole, before = W.partitionBy(*_PLACE), W.partitionBy(*_PLACE).orderBy("j").rowsBetween(W.unboundedPreceding, -1)
    up_to = W.partitionBy(*_PLACE).orderBy("j").rowsBetween(W.unboundedPreceding, 0)
    xor = lambda c, w: F.coalesce(F.bit_xor(c).over(w), F.lit(0))
    rest = xor("t", before).bitwiseXOR(xor("u", whole)).bitwiseXOR(xor("u", up_to))
    hashed = each.select(*_PLACE, "n", "j", rest.alias("rest"), xor("t", whole).alias("own"))
    deleted = hashed.select(*_PLACE, F.col("j").cast("int").alias("j"), F.xxhash64("rest", F.col("n") - 1).alias("v"))
    kept = hashed.filter("j = 0").select(*_PLACE, F.lit(-1).alias("j"), F.xxhash64("own", "n").alias("v"))
    variants = deleted.union(kept)
    met = cut(variants.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1").select("v"))
    variants = cut(variants.join(small_or_merged(met), "v"))

    # the earliest of equal keys: words replaced at the same place, or one word more or less
    gone, whole_line = variants.filter("j >= 0"), variants.filter("j < 0")
    least = lambda df, *by: df.groupBy(*by).agg(F.min(F.struct(*_PLACE, "j")).alias("first"))
    pairs = [
        gone.join(least(gone, "v", "j").hint("merge"), ["v", "j"]),
        gone.join(least(whole_line, "v").hint("merge"), "v"),
        whole_line.join(least(gone, "v").hint("merge"), "v"),
    ]
    named = [p.select(*_PLACE, "j", F.col("first.key").alias("key2"), F.col("first.row").alias("row2"), F.col("first.ln").alias("ln2"), F.col("first.j").alias("j2")) for p in pairs]
    pairs = reduce(DataFrame.union, named).filter(_place() > F.struct("key2", "row2", "ln2"))
    if units is not line_words:
        # in a run of one character any deletion gives the same line: one of them is enough
        pairs = pairs.groupBy(*_PLACE, "key2", "row2", "ln2").agg(F.min(F.struct("j", "j2")).alias("at")).select(*_PLACE, "key2", "row2", "ln2", "at.*")
    pairs = cut(pairs)
    other = lines.select(*(F.col(c).alias(c + "2") for c in [*_PLACE, "words"]))
    checked = pairs.join(lines.hint("merge"), _PLACE).join(other.hint("merge"), ["key2", "row2", "ln2"])
    left = lambda w, j: F.when(F.col(j) < 0, F.col(w)).otherwise(_without(F.col(w), F.col(j)))
    near = checked.filter((left("words", "j") == left("words2", "j2")) & (F.size("words") >= least_units) & (F.size("words2") >= least_units))
    return near.select(*_PLACE, F.lit(True).alias("near"))


COUNTS = ("n_lines", "n_equal", "n_near")


def deduplicate(docs: DataFrame, *, min_words: int = MIN_WORDS, min_chars: int | None = None, counts: bool = True) -> DataFrame:
    """``docs`` with the kept lines as text; with ``counts`` also n_lines, n_equal, n_near (lines removed), in the place of columns so named."""
    gone = removed_lines(docs, min_words=min_words, min_chars=min_chars).groupBy("key", "row").agg(F.sort_array(F.collect_list("ln")).alias("_ld_gone"), F.count_if("near").alias("_ld_near"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    rows = docs.withColumn("_ld_key", key).withColumn("_ld_row", F.xxhash64("text"))
    gone = gone.withColumnsRenamed({"key": "_ld_key", "row": "_ld_row"})
    split = rows.join(gone.hint("merge"), ["_ld_key", "_ld_row"], "left").select("*", F.explode(F.array(F.split("text", "\n"))).alias("_ld_lines"))
    # whole stretches between removed lines are taken, so the work is linear in the lines
    edges = F.concat(F.array(F.lit(-1)), F.col("_ld_gone"), F.array(F.size("_ld_lines")))
    stretch = F.flatten(F.transform(F.sequence(F.lit(1), F.size("_ld_gone") + 1), lambda i: F.slice("_ld_lines", F.element_at("_ld_edges", i) + 2, F.element_at("_ld_edges", i + 1) - F.element_at("_ld_edges", i) - 1)))
    split = split.select("*", F.explode(F.array(edges)).alias("_ld_edges"))
    text = F.when(F.col("_ld_gone").isNull(), F.col("text")).otherwise(F.array_join(stretch, "\n"))
    n = F.coalesce(F.size("_ld_gone"), F.lit(0))
    n_gone = F.when(F.col("_ld_gone").isNull(), 0).otherwise(n).cast("long")
    near = F.coalesce("_ld_near", F.lit(0)).cast("long")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("_ld_lines")).cast("long")
    kept = [F.col(c) if c != "text" else text.alias("text") for c in docs.columns if not counts or c not in COUNTS]
    if not counts:
        return split.select(*kept)
    return split.select(*kept, n_lines.alias("n_lines"), (n_gone - near).alias("n_equal"), near.alias("n_near"))


ORACLE = f"""
    WITH t AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
    l AS (SELECT doc_id, unnest(range(len(ls))) AS ln, unnest(ls) AS line FROM t),
    w AS (SELECT *, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM l),
    e AS (SELECT *, row_number() OVER (PARTITION BY ws ORDER BY doc_id, ln) > 1 AS dup FROM w WHERE len(ws) > 0),
    c AS (SELECT doc_id, ln, ws, (doc_id, ln) AS pos FROM e WHERE NOT dup AND len(ws) >= {MIN_WORDS}),
    d AS (SELECT pos, i, list_concat(ws[1:i], ws[i + 2:]) AS v FROM (SELECT *, unnest(range(len(ws))) AS i FROM c)),
    n AS (SELECT b.pos FROM d a JOIN d b ON a.v = b.v AND a.i = b.i AND a.pos < b.pos
          UNION SELECT d.pos FROM c JOIN d ON c.ws = d.v AND c.pos < d.pos
          UNION SELECT c.pos FROM c JOIN d ON c.ws = d.v AND d.pos < c.pos),
    g AS (SELECT w.doc_id, w.ln, w.line, coalesce(e.dup, false) AS dup, n.pos IS NOT NULL AS near
          FROM w LEFT JOIN e USING (doc_id, ln) LEFT JOIN n ON n.pos = (w.doc_id, w.ln))
    SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT dup AND NOT near), '') AS text,
           count(*) AS n_lines, count(*) FILTER (dup) AS n_equal, count(*) FILTER (near) AS n_near
    FROM g GROUP BY doc_id"""


def keep_new_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, min_chars: int | None = None) -> DataFrame:
    """``docs`` with the kept lines as text and their length as n_chars, without documents of which no word is left.

    Documents that had no words before stay as they are.
    """
    kept = deduplicate(docs.withColumn("_ld_had", F.col("text").rlike(r"[^\x20\x09-\x0D]")), min_words=min_words, min_chars=min_chars, counts=False)
    kept = kept.filter(F.col("text").isNull() | ~F.col("_ld_had") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    n = [F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns]
    return kept.select(*n)


