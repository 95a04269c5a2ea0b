"""Removal of every byte that a repeated SPAN-byte string covers, with a sparse distributed suffix array.

With words, every passage of so many words that repeats goes too: its text is then the codes of its words, WORD
bytes each, and the span that many codes.

Sorting the suffixes of all byte positions would move each text hundreds of times. Instead, suffixes start at
anchors: of each SPAN-byte window, the leftmost position with the least hash of its next LEAD bytes. An
anchor depends on the window's bytes alone, so equal windows have anchors at the same offset, and an anchor
stands for the run of windows that chose it (about one a hundred and seventy bytes).

1. Each anchor posts a hash of its leading bytes and one of all bytes its windows cover. Anchors with equal
   covers repeat in all their windows, and are settled by counting alone. So are those whose lead is unique.
   A text posts equal anchors once, with their number and the runs that they cover, so lines that a text
   repeats over and over don't multiply rows.
2. The rest (anchors at the ends of repeats) carry their bytes. Sampled splitters range-partition these
   suffixes by their leading bytes, buckets are sorted, and within a run of equal leads each window is
   compared by its position against the anchor and its fingerprint; a lead never straddles two buckets.
   The left context counts too, which is why fingerprints stand in for common prefix lengths here.
3. Leads with more than HOT covers aren't brought together: their windows are cut into ever smaller cells. Of each
   cell, counting settles anchors whose bytes all repeat and those whose common bytes don't; the rest is cut on,
   down to single windows. Partial aggregates do the counting, so no task meets all of a lead.

Strings are judged on the input; overlapping occurrences and those in one text count. Fingerprints are 64 bit
polynomials over random byte values, always compared together with the lead's.

Defined results: null is the empty text; texts under SPAN bytes keep all; rows of one id with equal texts repeat
each other; ids may be of any type, null too; byte removal may cut characters, so kept is binary; columns named as
an output, in any case, are replaced; an empty table gives an empty table.
Words are what ASCII white space separates; the white space itself may differ between passages, and goes between
neighbouring words that are both cut, even where one passage ends and the next begins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm.common import ODD, Prints, byte_view, col, condensed, fields_of, free_names, held, mixed, others, small, small_batches, tidy, trim
from orbweave.llm.encoder import sliced

SPAN, LEAD, HOT = 400, 64, 1000
A_RANGE = 10_000  # suffixes of a range of leading bytes: about 6 MB with their bytes
CELLS = (85, 9, 1)
WORD = 8  # bytes of a word's code
OUTPUTS = ("n_bytes", "n_removed", "n_spans", "kept")
RUNS = "array<struct<a:long,b:long>>"
ANCHOR = f"id long, th long, unit tinyint, pos int, o1 int, o2 int, first long, lead long, cover long, m int, more {RUNS}"
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


def anchors(raw: np.ndarray, off: np.ndarray, prints: Prints, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """For texts raw[off[i]:off[i+1]]: text number, anchor, first and last window start, of each anchor (places in raw)."""
    n, reach = len(raw), span - LEAD + 1  # reach: places for an anchor in a window
    none = (np.zeros(0, np.int64),) * 4
    if n < span:
        return none
    at = np.arange(n - LEAD + 1)
    least = (prints.of(at, at + LEAD) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the windows that start at 0, 1, ... n - span
    doc = np.repeat(np.arange(len(off) - 1), np.maximum(0, np.diff(off) - span + 1))
    if not len(doc):
        return none
    size = np.maximum(0, np.diff(off) - span + 1)
    start = off[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    place = place[start]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([new[1:], [len(doc)]]) - 1
    return doc[new], place[new], start[new], start[last]


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and the offsets of each text in these."""
    inside, edge = ~SPACE[raw], np.zeros(len(raw) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside])[:-1]))
    end = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside, [False]])[1:])) + 1
    return start, end, np.searchsorted(start, off)


def word_codes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all words, as bytes, and the offsets of each text in these."""
    start, end, first = word_bounds(raw, off)
    return Prints(raw).of(start, end).astype("<u8").view(np.uint8), first * WORD


def _texts_of(batches, columns: int, name: str = "text"):
    """Slices of batches (..., text): the other columns, the bytes and the offsets."""
    for whole in batches:
        for b in sliced(whole, name):
            raw, off = byte_view(b.column(name))
            yield [b.column(i) for i in range(columns)], raw[off[0] : off[-1]], off - off[0]
    trim()


def _first_bytes(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), np.int64)
    for j in range(7):
        out = out * 256 + raw[at + j]
    return out


def _post(spans: list[int]):
    """Anchors of the texts' bytes (unit 0) and, with a second span, of the codes of their words (unit 1)."""

    def rows(unit: int, ids, ths, raw, off):
        span, prints = spans[unit], Prints(raw)
        doc, at, p1, p2 = anchors(raw, off, prints, span)
        if not len(doc):
            return
        lead = prints.of(at, at + LEAD) ^ (ODD[4] * np.uint64(unit))
        cover = mixed(prints.of(p1, p2 + span) + (at - p1).astype(np.uint64) * ODD[3])
        order = np.lexsort((cover, lead, doc))  # stable: equal anchors stay in the order of their text
        doc, at, p1, p2, lead, cover = (x[order] for x in (doc, at, p1, p2, lead, cover))
        head = np.concatenate([[True], (np.diff(doc) != 0) | (lead[1:] != lead[:-1]) | (cover[1:] != cover[:-1])])
        one = np.flatnonzero(head)
        m = np.diff(np.append(one, len(doc)))
        a, b = p1 - off[doc], p2 - off[doc] + span
        apart = head.copy()
        apart[1:] |= a[1:] > b[:-1]
        new = np.flatnonzero(apart & np.repeat(m > 1, m))
        end = np.append(np.flatnonzero(apart)[1:], len(doc))[np.cumsum(apart)[new] - 1] - 1
        parts = np.concatenate([[0], np.cumsum(np.bincount((np.cumsum(head) - 1)[new], minlength=len(one)))]).astype(np.int32)
        more = pa.ListArray.from_arrays(pa.array(parts), pa.StructArray.from_arrays([pa.array(a[new]), pa.array(b[end])], names=["a", "b"]))
        doc, at, p1, p2, lead, cover = (x[one] for x in (doc, at, p1, p2, lead, cover))
        row = pa.array(doc)
        values = (np.full(len(doc), unit, np.int8), (at - off[doc]).astype(np.int32), (at - p2).astype(np.int32), (at - p1).astype(np.int32), _first_bytes(raw, at), lead.view(np.int64), cover.view(np.int64), m.astype(np.int32))
        yield pa.RecordBatch.from_arrays([ids.take(row), ths.take(row), *map(pa.array, values), more], names=["id", "th", "unit", "pos", "o1", "o2", "first", "lead", "cover", "m", "more"])

    def run(batches):
        for (ids, ths), raw, off in _texts_of(batches, 2):
            yield from rows(0, ids, ths, raw, off)
            if len(spans) > 1:
                yield from rows(1, ids, ths, *word_codes(raw, off))

    return run


def _wanted(batches):
    """For each slice of texts (id, th, wanted, text) and each unit that is wanted of it: ids, ths, bytes (or codes), text number and fields of the wanted structs, with places in the slice."""
    for (ids, ths, lists), raw, off in _texts_of(batches, 3):
        parts = np.asarray(lists.offsets).astype(np.int64)
        row = np.repeat(np.arange(len(lists)), np.diff(parts))
        flat = lists.flatten()
        got = {f.name: np.asarray(flat.field(i)) for i, f in enumerate(flat.type)}
        for unit in np.unique(got["unit"]).tolist():
            own = np.flatnonzero(got["unit"] == unit)
            of, w = row[own], {k: v[own] for k, v in got.items()}
            data, place = word_codes(raw, off) if unit else (raw, off)
            w["at"] = place[of] + w["pos"]
            yield ids, ths, data, of, w


def _carry(spans: list[int]):
    """Anchors with the bytes that their windows cover."""

    def run(batches):
        for ids, ths, raw, row, w in _wanted(batches):
            data, span = memoryview(raw.tobytes()), spans[w["unit"][0]]
            texts = [data[a:b] for a, b in zip((w["at"] - w["o2"]).tolist(), (w["at"] - w["o1"] + span).tolist())]
            r = pa.array(row)
            yield pa.RecordBatch.from_arrays([ids.take(r), ths.take(r), *[pa.array(w[k]) for k in ("unit", "pos", "o1", "o2", "part", "lead", "n")], pa.array(texts, pa.binary())], names=["id", "th", "unit", "pos", "o1", "o2", "part", "lead", "n", "bytes"])

    return run


def _windows(o1: np.ndarray, o2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor's windows in ascending order of their start: anchor number and offset of the anchor."""
    n = o2 - o1 + 1
    row = np.repeat(np.arange(len(n)), n)
    return row, o2[row] - (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))


def _compare(spans: list[int]):
    """Sorted suffixes: the runs [a, b) of bytes that repeated windows cover, for anchors that stand alone."""
    spans = np.array(spans)

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0

        def settle(rows: pa.RecordBatch):
            pos, o1, o2, lead, n = (np.asarray(rows.column(k)).astype(np.int64) for k in ("pos", "o1", "o2", "lead", "n"))
            raw = np.frombuffer(b"".join(rows.column("bytes").to_pylist()), np.uint8)
            span = spans[np.asarray(rows.column("unit"))]
            off = np.cumsum(o2 - o1 + span) - (o2 - o1 + span)
            row, o = _windows(o1, o2)
            start = off[row] + o2[row] - o
            name = mixed(Prints(raw).of(start, start + span[row]) + o.astype(np.uint64) * ODD[2] + lead.view(np.uint64)[row] * ODD[3])
            _, which = np.unique(name, return_inverse=True)
            again = (np.bincount(which, weights=n[row])[which] >= 2) & (n[row] == 1)
            at = np.flatnonzero(again)
            if not len(at):
                return
            cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(row[at]) != 0))
            lo, hi = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])]
            a, b = pos[row[lo]] - o[lo], pos[row[lo]] - o[hi] + span[row[lo]]
            r = pa.array(row[lo])
            yield pa.RecordBatch.from_arrays([*[rows.column(k).take(r) for k in ("id", "th", "unit")], pa.array(a), pa.array(b)], names=["id", "th", "unit", "a", "b"])

        for whole in batches:
            for a in range(0, whole.num_rows, 200):
                held.append(whole.slice(a, 200))
                size += held[-1].column("bytes").nbytes
                if size > 1 << 18:
                    rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    lead = np.asarray(rows.column("lead"))
                    other = np.flatnonzero(lead != lead[-1])
                    if len(other):  # the last lead may go on
                        yield from settle(rows.slice(0, other[-1] + 1))
                        held = [rows.slice(other[-1] + 1)]
                        size = held[0].column("bytes").nbytes
                    else:
                        held = [rows]
        if held:
            yield from settle(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
        trim()

    return run


def _cells(width: int, spans: list[int]):
    """The windows of wanted anchors, width offsets together: name tells the bytes that any window of the cell covers, cover those that all the anchor's windows in it cover."""

    def run(batches):
        for ids, ths, raw, row, w in _wanted(batches):
            span = spans[w["unit"][0]]
            o1, o2 = w["o1"].astype(np.int64), w["o2"].astype(np.int64)
            n = o2 // width - o1 // width + 1
            own = np.repeat(np.arange(len(n)), n)
            cell = (o1 // width)[own] + np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            low, high = cell * width, np.minimum(cell * width + width - 1, span - LEAD)
            at, prints = w["at"][own], Prints(raw)
            name = mixed(prints.of(at - low, at - high + span) + cell.astype(np.uint64) * ODD[2] + w["name"].view(np.uint64)[own] * ODD[3])
            low, high = np.maximum(low, o1[own]), np.minimum(high, o2[own])
            cover = mixed(prints.of(at - high, at - low + span) + high.astype(np.uint64) * ODD[2])
            r = pa.array(row[own])
            values = (w["unit"][own], w["pos"][own], low.astype(np.int32), high.astype(np.int32), w["n"][own], name.view(np.int64), cover.view(np.int64))
            yield pa.RecordBatch.from_arrays([ids.take(r), ths.take(r), *map(pa.array, values)], names=["id", "th", "unit", "pos", "o1", "o2", "n", "name", "cover"])

    return run


def _joined(lists):
    """Lists of runs, each sorted and with those that meet made one."""
    parts = np.asarray(lists.offsets).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), np.diff(parts))
    a, b = (np.asarray(lists.flatten().field(k)) for k in (0, 1))
    order = np.lexsort((a, row))
    row, a, b = row[order], a[order], b[order]
    far = b + row * (apart := int(b.max(initial=0)) + 1)  # ends rise from text to text, so a running maximum stays in its text
    before = np.concatenate([[-1], np.maximum.accumulate(far)[:-1]])[: len(a)]
    new = np.flatnonzero(a + row * apart > before)
    end = np.maximum.reduceat(b, new) if len(new) else b
    offsets = np.concatenate([[0], np.cumsum(np.bincount(row[new], minlength=len(lists)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(a[new]), pa.array(end)], names=["a", "b"]))


def _merged(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(_joined, batch.columns[2:])], names=batch.schema.names)
    trim()


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", span: int = SPAN, words: int = 0) -> DataFrame:
    """(id, th, runs0): for rows (id and th: xxhash64 of their id and text) with repeats, the disjoint runs [a, b) of bytes that repeated strings of span bytes cover, in order.

    With words, also runs1: the same for passages of that many words, as places in the codes of the text's words. Both come from one pass."""
    spans = [span, words * WORD] if words else [span]
    if min(spans) < 2 * LEAD:
        raise ValueError(f"a span has {2 * LEAD} bytes or {2 * LEAD // WORD} words at least")
    small_batches(docs.sparkSession)
    texts = docs.select(F.xxhash64(col(doc_id)).alias("id"), F.xxhash64(col(text_col)).alias("th"), col(text_col).alias("text")).filter(F.octet_length("text") >= min(span, 2 * words - 1 if words else span))
    posts = held(texts.mapInArrow(_post(spans), ANCHOR))
    leads = condensed(posts.groupBy("lead").agg(F.sum("m").alias("s")).filter("s > 1").select(F.col("lead").alias("k")), "leads")
    shared = held(posts.join(small(leads), F.col("lead") == F.col("k"), "left_semi"))
    place = ("id", "th", "unit", "pos", "o1", "o2")
    covers = shared.groupBy("lead", "cover").agg(F.sum("m").alias("n"), F.min(F.struct(*place, "first")).alias("one"))
    covers = condensed(covers, "covers")
    posts.unpersist()  # shared holds what is left of them
    twice = small(covers.filter("n > 1").select(F.col("lead").alias("k"), F.col("cover").alias("c")))
    whole = shared.join(twice, (F.col("lead") == F.col("k")) & (F.col("cover") == F.col("c")), "left_semi")

    def run(a, b):
        return F.array(F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))).alias("runs")

    its_own = run(F.col("pos") - F.col("o2"), F.col("pos") - F.col("o1") + F.when(F.col("unit") == 0, span).otherwise(spans[-1]))
    runs = whole.select("id", "th", "unit", F.when(F.col("m") > 1, F.col("more")).otherwise(its_own).alias("runs"))

    mixed_leads = condensed(covers.groupBy("lead").agg(F.count("*").alias("m"), F.min("n").alias("low")).filter("m > 1 AND low = 1").select(F.col("lead").alias("k"), "m"), "mixed")
    open_ = covers.join(small(mixed_leads), F.col("lead") == F.col("k")).select("one.*", "lead", F.least("n", F.lit(2)).cast("int").alias("n"), (F.col("m") > HOT).alias("hot"))
    # Spark samples the splitters of the leading bytes; the number of ranges follows the suffixes
    alone = open_.filter("NOT hot")
    ranged = held(alone.repartitionByRange(1 + alone.count() // A_RANGE, "first", "lead").withColumn("part", F.spark_partition_id()))

    def with_text(rows: DataFrame, *fields: str) -> DataFrame:
        by_text = condensed(rows.groupBy(F.col("id").alias("i"), F.col("th").alias("t")).agg(F.collect_list(F.struct(*fields)).alias("wanted")), "wanted")
        return texts.join(small(by_text), (F.col("id") == F.col("i")) & (F.col("th") == F.col("t"))).select("id", "th", "wanted", "text")

    own = "id long, th long, unit tinyint"
    carried = with_text(ranged, "unit", "pos", "o1", "o2", "part", "lead", "n").mapInArrow(_carry(spans), f"{own}, pos int, o1 int, o2 int, part int, lead long, n int, bytes binary")
    n_parts = (ranged.agg(F.max("part")).first()[0] or 0) + 1
    compared = carried.repartitionById(n_parts, F.col("part")).sortWithinPartitions("lead").mapInArrow(_compare(spans), f"{own}, a long, b long")
    runs = runs.union(compared.select("id", "th", "unit", run(F.col("a"), F.col("b"))))

    hot = open_.filter("hot")
    if mixed_leads.filter(F.col("m") > HOT).limit(1).count():
        alive = hot.withColumnRenamed("lead", "name")
        for width in CELLS:
            cells = with_text(alive, "unit", "pos", "o1", "o2", "name", "n").mapInArrow(_cells(width, spans), f"{own}, pos int, o1 int, o2 int, n int, name long, cover long")
            cells = held(cells)
            covers = cells.groupBy("name", "cover").agg(F.sum("n").alias("s"), F.min(F.struct(*place)).alias("one"))
            covers = condensed(covers, "cell-covers")
            twice = small(covers.filter("s > 1").select(F.col("name").alias("k"), F.col("cover").alias("c")))
            found = cells.filter("n = 1").join(twice, (F.col("name") == F.col("k")) & (F.col("cover") == F.col("c")), "left_semi")
            runs = runs.union(found.select("id", "th", "unit", its_own))
            several = condensed(covers.groupBy("name").agg(F.count("*").alias("m"), F.min("s").alias("low")).filter("m > 1 AND low = 1").select(F.col("name").alias("k")), "cell-mixed")
            alive = covers.join(small(several), F.col("name") == F.col("k"), "left_semi").select("one.*", "name", F.least("s", F.lit(2)).cast("int").alias("n"))
    lists = [F.flatten(F.collect_list(F.when(F.col("unit") == k, F.col("runs")))).alias(f"runs{k}") for k in range(len(spans))]
    return runs.groupBy("id", "th").agg(*lists).mapInArrow(_merged, "id long, th long" + "".join(f", runs{k} {RUNS}" for k in range(len(spans))))


def _with_runs(docs: DataFrame, kept: list[str], doc_id: str, text_col: str, words: int = 0) -> tuple[DataFrame, str]:
    """The kept columns of docs, then the runs to cut (with words, those of words too) and the text, as the last column; and its name."""
    text = free_names(docs.columns, "text")[0]
    names = free_names([*docs.columns, text], "span_id", "span_th", "span_runs0", *["span_runs1"] * bool(words))
    with tidy(docs.sparkSession) as keep:
        spans = small(keep(condensed(repeated_spans(docs, doc_id, text_col, words=words), "spans"))).toDF(*names)
    same = (F.xxhash64(docs[f"`{doc_id}`"]) == F.col(names[0])) & (F.xxhash64(docs[f"`{text_col}`"]) == F.col(names[1]))
    return docs.join(spans, same, "left").select(*[docs[f"`{c}`"] for c in kept], *names[2:], docs[f"`{text_col}`"].alias(text)), text


def _gone(lists, raw: np.ndarray, off: np.ndarray, words: bool = False) -> np.ndarray:
    """Which bytes the runs of each text cover."""
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets).astype(np.int64)))
    flat = lists.flatten()
    a, b = (np.asarray(flat.field(k)) for k in (0, 1))
    if words:  # only whole words; the white space between words of a run goes with them
        start, end, first = word_bounds(raw, off)
        a, b = -(-a // WORD) + first[row], b // WORD + first[row]
        a, b = start[a[a < b]], end[b[a < b] - 1]
    else:
        a, b = a + off[row], b + off[row]
    depth = np.bincount(a, minlength=len(raw) + 1).astype(np.int64)
    depth -= np.bincount(b, minlength=len(raw) + 1)
    return np.cumsum(depth)[: len(raw)] > 0


def _words_in(lists) -> np.ndarray:
    """How many whole words the runs of each row's codes cover."""
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets).astype(np.int64)))
    a, b = (np.asarray(lists.flatten().field(k)) for k in (0, 1))
    return np.bincount(row, weights=np.maximum(0, b // WORD + -a // WORD), minlength=len(lists)).astype(np.int64)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", keep_text: bool = False, words: int = 0) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (binary: the bytes that stay); the text goes unless keep_text.

    With words, also n_passage_words: how many words lie in passages of so many words that start elsewhere too. These are counted only, not cut."""
    outputs = OUTPUTS + ("n_passage_words",) * bool(words)
    kept = [c for c in others(docs, *outputs) if keep_text or c != text_col]
    rows, text = _with_runs(docs, kept, doc_id, text_col, words)
    schema, width = fields_of(docs, kept), len(rows.columns)

    def run(batches):
        for columns, raw, off in _texts_of(batches, width - 1, text):
            gone = _gone(columns[len(kept)], raw, off)
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            first = off[:-1][off[:-1] < len(raw)]
            starts[first] = gone[first]
            total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, starts))
            data = raw[~gone].tobytes()
            cut = (off - total[off]).tolist()
            found = [pa.array(np.diff(off)), pa.array(np.diff(total[off])), pa.array(np.diff(spans[off])), pa.array([data[x:y] for x, y in zip(cut, cut[1:])], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns[: len(kept)], *found, *[pa.array(_words_in(x)) for x in columns[len(kept) + 1 :]]], names=[*kept, *outputs])

    return rows.mapInArrow(run, f"{schema}n_bytes long, n_removed long, n_spans long, kept binary" + ", n_passage_words long" * bool(words))


def dedup_texts(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", words: int = 0) -> DataFrame:
    """docs with repeated strings cut out of their texts, and with words also repeated passages of that many words; bytes of a cut character go with it."""
    kept = [c for c in docs.columns if c != text_col]
    rows, text = _with_runs(docs, kept, doc_id, text_col, words)
    width = len(rows.columns)

    def run(batches):
        for columns, raw, off in _texts_of(batches, width, text):
            gone = _gone(columns[len(kept)], raw, off)
            if words:
                gone |= _gone(columns[-2], raw, off, words=True)
            texts = columns[-1].to_pylist()
            total = np.concatenate([[0], np.cumsum(gone)])[off]
            for i in np.flatnonzero(np.diff(total)).tolist():
                at = slice(off[i], off[i + 1])
                texts[i] = raw[at][~gone[at]].tobytes().decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([*columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, text_col])

    return rows.mapInArrow(run, f"{fields_of(docs, kept)}{fields_of(docs, [text_col])[:-2]}").select(*[col(c) for c in docs.columns])
