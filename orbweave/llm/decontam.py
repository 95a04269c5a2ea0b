"""Benchmark decontamination by winnowing (DataFrame functions only).

Both sides are cut into lower-cased words. The hash of every SPAN-word gram is taken, and of each
WINDOW consecutive ones the least is kept, so any run of at least SPAN + WINDOW - 1 = 10 equal words keeps
the same gram on both sides. Equal fingerprints meet in a join; each meeting is extended word by word
to both sides (words are compared, not hashes), and the words of a run of 10 or more are hit.
An item of fewer than 10 words is one window: for the lengths that occur, every gram of that length
in a document is looked up and compared likewise.

The benchmark's fingerprints are counted first and broadcast up to BROADCAST_ROWS of them; beyond that the
join shuffles, and fingerprints carry the words around them. Matches are gathered by document only, and
as distinct intervals of words.

Defined results: null or wordless texts have 0 words and are clean; items without words are left out;
equal document rows give equal result rows; empty tables give empty or clean results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import ascii_lower, col, stored, without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, WINDOW = 5, 6
SHORTEST = SPAN + WINDOW - 1
BROADCAST_ROWS = 200_000


def words_of(text) -> F.Column:
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _grams(words: str, n: int) -> str:
    """SQL: the hash of each gram of n words of the array column, in order."""
    rest = ", ".join(f"get(w, i + {j})" for j in range(1, n))
    return f"CASE WHEN size({words}) < {n} THEN array() ELSE slice(transform({words}, (x, i) -> xxhash64({n}, x{', ' + rest if n > 1 else ''})), 1, size({words}) - {n - 1}) END".replace("get(w,", f"get({words},")


def _winnowed(df: DataFrame, words: str, out: str, short: list[int]) -> DataFrame:
    """df with out: array of (at, n, gram), positions counted from 0."""
    df = df.withColumn("_g", F.expr(_grams(words, SPAN)))
    least = ", ".join(["x"] + [f"get(_g, i + {j})" for j in range(1, WINDOW)])
    # a window's position is that of its least gram, the first of equal ones; windows that run over the end only repeat
    df = df.withColumn("_m", F.expr(f"transform(_g, (x, i) -> least({least}))"))
    chosen = "filter(transform(_g, (x, i) -> struct(i AS at, {n} AS n, x AS gram)), (s, i) -> " + " OR ".join(f"(i >= {j} AND get(_m, i - {j}) = s.gram)" if j else "get(_m, i) = s.gram" for j in range(WINDOW)) + ")"
    parts = [chosen.replace("{n}", str(SPAN))]
    parts += [f"transform({_grams(words, n)}, (x, i) -> struct(i AS at, {-n} AS n, x AS gram))" for n in short]
    return df.withColumn(out, F.expr(f"concat({', '.join(parts)})") if short else F.expr(parts[0])).drop("_g", "_m")


def find_contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, hits (disjoint runs [from, upto) of hit words), items (item ids, sorted as strings), n_hit, n_items; a row for each row of docs."""
    items = benchmark.select(col(item_id).cast("string").alias("item"), words_of(col(item_text)).alias("iw")).filter("size(iw) > 0")
    lengths = sorted(r[0] for r in items.filter(F.size("iw") < SHORTEST).select(F.size("iw")).distinct().collect())  # nine at most
    marks = _winnowed(items.filter(F.size("iw") >= SHORTEST), "iw", "f", [])
    marks = marks.select("item", "iw", F.explode_outer("f").alias("f"))
    for n in lengths:
        marks = marks.union(items.filter(F.size("iw") == n).select("item", "iw", F.expr(f"struct(0 AS at, {-n} AS n, {_grams('iw', n)}[0] AS gram)").alias("f")))
    before, around = SHORTEST - SPAN, 2 * SHORTEST - SPAN

    def context(words: str, at: str) -> F.Column:
        return F.expr(f"slice(concat(array_repeat(CAST(NULL AS string), greatest(0, {before} - {at})), slice({words}, greatest(1, {at} - {before - 1}), {around} - greatest(0, {before} - {at}))), 1, {around})")

    marks = marks.select(F.col("f.gram").alias("gram"), F.col("f.n").alias("n"), "item", context("iw", "f.at").alias("ic")).distinct().groupBy("gram", "n", "ic").agg(F.collect_set("item").alias("item"))
    small = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    words = docs.select(col(doc_id).alias("id"), F.xxhash64(col(text_col)).alias("_h"), words_of(col(text_col)).alias("w"))
    probes = _winnowed(words, "w", "f", lengths)
    # the first entry stands for the row itself; explode() would make Spark push a filter with all that f is made of into the scan
    probes = probes.select("id", "_h", "w", F.explode_outer(F.expr("concat(array(struct(-1 AS at, 0 AS n, CAST(0 AS bigint) AS gram)), f)")).alias("f"))
    probes = probes.select("id", "_h", "w", F.col("f.at").alias("at"), F.col("f.n").alias("n"), F.col("f.gram").alias("gram"))
    if not small:
        probes = probes.select("id", "_h", F.when(F.col("at") < 0, F.array_repeat(F.lit(""), F.size("w"))).otherwise(context("w", "at")).alias("w"), "at", "n", "gram")
    met = probes.join(F.broadcast(marks) if small else marks, ["gram", "n"], "left").filter("at < 0 OR item IS NOT NULL")
    met = met.select("id", "_h", "at", "n", "item", "ic", F.when(F.col("at") < 0, F.size("w")).alias("n_words"), F.when(F.col("at") >= 0, context("w", "at") if small else F.col("w")).alias("c"))
    # equal words next to the gram: how many to its left, how many from its start on
    same = F.expr("CASE WHEN at >= 0 THEN zip_with(c, ic, (x, y) -> coalesce(x = y, false)) END")
    met = met.withColumn("_same", same).drop("c", "ic")
    left = " + ".join("(" + " AND ".join(f"coalesce(get(_same, {before - k}), false)" for k in range(1, j + 1)) + ")::int" for j in range(1, before + 1))
    right = F.expr(f"coalesce(nullif(array_position(slice(_same, {before + 1}, {around - before}), false), 0) - 1, greatest(0, size(_same) - {before}))").cast("int")
    met = met.withColumn("_l", F.when(F.col("n") == SPAN, F.expr(left)).otherwise(0)).withColumn("_r", F.when(F.col("n") < 0, F.least(right, -F.col("n"))).otherwise(right))
    good = F.when(F.col("n") < 0, F.col("_r") == -F.col("n")).otherwise((F.col("_r") >= SPAN) & (F.col("_l") + F.col("_r") >= SHORTEST))
    hit = F.when((F.col("at") >= 0) & good, F.struct((F.col("at") - F.col("_l")).alias("from"), (F.col("at") + F.col("_r")).alias("upto")))
    met = met.select("id", "_h", "n_words", hit.alias("hit"), F.when(hit.isNotNull(), F.col("item")).alias("item"))
    by_doc = met.groupBy("id", "_h").agg(F.count("n_words").alias("_rows"), F.max("n_words").alias("n_words"), F.sort_array(F.collect_set("hit")).alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("item")))).alias("items"))
    joined = """aggregate(hits, CAST(array() AS array<struct<from:int,upto:int>>), (a, x) -> CASE WHEN size(a) > 0 AND element_at(a, -1).upto >= x.from
        THEN concat(slice(a, 1, size(a) - 1), array(struct(element_at(a, -1).from AS from, greatest(element_at(a, -1).upto, x.upto) AS upto))) ELSE concat(a, array(x)) END)"""
    by_doc = by_doc.withColumn("hits", F.expr(joined))
    n_hit = F.expr("aggregate(hits, 0L, (a, x) -> a + x.upto - x.from)")
    return by_doc.select(F.explode(F.expr("array_repeat(id, CAST(_rows AS int))")).alias(doc_id), F.col("n_words").cast("long").alias("n_words"), "hits", "items", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose id has a window of an item; rows without an id stay."""
    bad = find_contamination(docs.select(col(doc_id), col(text_col)), benchmark, doc_id, text_col).filter("n_hit > 0").select(col(doc_id)).distinct()
    return without(docs, stored(bad, "contaminated"), doc_id)
