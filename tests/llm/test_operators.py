"""The operators against brute force, on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbweave.llm import bpe, common, decontam, encoder, jaccard, neardup, quality, queries, sharding, suffix_dedup, token_count, token_orc, url_filter

pytest.importorskip("public_tokenizers")
BYTE, WORD = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("word_bpe_49k.json")
LOW = {i: i + 32 for i in range(65, 91)}


def passages(seed, n):
    r = random.Random(seed)
    base = [" ".join(r.choice(["ab", "Cd", "é", "xyz", "1"]) for _ in range(r.choice([3, 5, 20, 90, 200]))) for _ in range(20)]
    rows = []
    for i in range(n):
        w = " ".join(r.choice(base) for _ in range(r.randint(1, 3))).split()
        for _ in range(r.choice([0, 0, 1, 2])):
            w[r.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "x" * 2000), (n + 4, rows[0][1])]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


def test_url_filter(spark):
    urls = [None, "", "no scheme", "http://COM", "http://com/", "http://a.com/x", "http://example.com/en/1?q", "https://www.Example.com/en/1#x", "http://xexample.com/en/1", "ftp://net/es/", "http://a.b.net/fr/", "http:///en/", "http://a.net/es"]
    rows = [(i, u, "own") for i, u in enumerate(urls)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, Host string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(df, queries.URL_RULES).collect()}
    for i, u in enumerate(urls):
        host, path = "", ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            host, path = m[1].translate(LOW), m[2]
        fit = max(((h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)), key=lambda x: len(x[0]), default=(None, "allow"))
        assert got[i] == fit, u
    assert url_filter.filter_urls(df, queries.URL_RULES).count() == len(rows) and url_filter.filter_urls(df.limit(0), queries.URL_RULES).count() == 0


def test_quality(spark):
    r = random.Random(1)
    rows = [(i, "".join(r.choice("abc de" if i % 3 else "@#$% !") for _ in range(r.randint(1, 900)))) for i in range(300)] + [(300, None), (301, "")]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)], "doc_id long, quality int")
    got = {x["doc_id"]: x["score"] for x in quality.score(docs, quality.train(docs, labels)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (i % 3 > 0) for i in held]) > 0.9
    assert quality.score(docs.limit(0), quality.train(docs, labels.limit(0))).count() == 0


def test_sharding(spark):
    docs = frame(spark, passages(1, 300))
    rows = sharding.shard(docs, 16).collect()
    sizes = Counter(x["shard"] for x in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(x["slot"] for x in rows if x["shard"] == s) == list(range(n)) for s, n in sizes.items())
    assert all(x["size"] == len((x["text"] or "").encode()) + 1 and x["text_crc32"] == zlib.crc32((x["text"] or "").encode()) for x in rows)
    assert {(x["doc_id"], x["shard"], x["slot"]) for x in rows} == {(x["doc_id"], x["shard"], x["slot"]) for x in sharding.shard(docs.repartition(3), 16).collect()}
    assert sharding.shard(docs.limit(0)).count() == 0
    m = sharding.communication_matrix([10, 0, 7, 2_000_000_000], 4, 3)
    assert m.sum(axis=1).tolist() == [10, 0, 7, 2_000_000_000] and np.ptp(m.sum(axis=0)) <= 1


def test_near_duplicates(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, 4))
    rows = [(i, [float(x) for x in centres[rng.integers(9)] + rng.normal(size=4) * rng.choice([0, 0.02, 0.2])]) for i in range(500)]
    rows += [(500 + i, v) for i, v in enumerate([None, [], [0.0] * 4, [math.nan] * 4, [math.inf, 1.0, 1.0, 1.0], [None, 1.0, 1.0, 1.0], [1e200] * 4, [1.0, 2.0], [2.0, 4.0]])]
    for block in (2 << 20, 960):
        neardup.BLOCK_BYTES, before = block, neardup.BLOCK_BYTES
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        neardup.BLOCK_BYTES = before
        good = [(i, np.array(v) / np.abs(v).max()) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
        link = {i: {j for j, w in good if len(w) == len(v) and j != i and v @ w >= 0.95 * np.linalg.norm(v) * np.linalg.norm(w)} for i, v in good}
        for i, _ in rows:
            seen, todo = {i}, [i]
            while todo:
                new = link.get(todo.pop(), set()) - seen
                seen |= new
                todo += new
            assert got[i] == (len(link.get(i, ())), min(seen))


def test_jaccard(spark):
    rows = passages(5, 250)
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    link = {i: {j for j in sets if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])} for i in sets}
    for block in (100_000, 800):
        jaccard.BLOCK_SIZE, before = block, jaccard.BLOCK_SIZE
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(frame(spark, rows)).collect()}
        jaccard.BLOCK_SIZE = before
        for i in sets:
            seen, todo = {i}, [i]
            while todo:
                new = link[todo.pop()] - seen
                seen |= new
                todo += new
            assert got[i] == (len(sets[i]), min(seen))
    assert jaccard.similar_groups(frame(spark, rows).limit(0)).count() == 0


def shuffled_bytes(spark):
    """What all stages so far have written to shuffles."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    gate = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gate.new_array(gate.jvm.double, 0), gate.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_jaccard_moves_less_than_its_texts(spark):
    """Steps that one set alone has aren't posted, however many partitions there are; copies and an id with two texts don't hide links."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"{rng.randrange(10**6):x}" for _ in range(600 if i < 10 else 13_000))) for i in range(60)]  # longer than those that common_steps() draws
    rows += [(600 + i, rows[i][1] + " x") for i in range(5)] + [(610, rows[7][1]), (610, rows[9][1] + " y"), (611, rows[7][1]), (None, rows[8][1])]
    df = frame(spark, rows).cache()
    df.count()
    before, parts = shuffled_bytes(spark), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    try:
        got = {(r["doc_id"], r["component_id"]) for r in jaccard.similar_groups(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    linked = {i: i - 600 for i in range(600, 605)} | {611: 7}
    assert got == {(i, linked.get(i, i)) for i, _ in rows if i not in (None, 610)} | {(610, 7), (610, 9), (None, 8)}
    assert shuffled_bytes(spark) - before < sum(len(t) for _, t in rows) / 2


def test_components_settle_or_raise(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long").repartition(8)
    assert {tuple(x) for x in common.components(path, "path").collect()} == {(i, 0) for i in range(41)}
    common.STEPS, before = 1, common.STEPS
    try:
        with pytest.raises(RuntimeError):
            common.components(path, "path")
    finally:
        common.STEPS = before


ODD_TEXTS = [None, "", " a  b\n c", "It's THE É é́ Σ ΟΔΟΣ", "<|endoftext|> x <|startoftext|>", "tab\tnbsp zero​\x1c\x85", "日本 123 😀!!", "a" * 3000, "the the the"]


def test_encoders():
    from tokenizers import Tokenizer

    for path, ours in ((BYTE, encoder.PieceEncoder(BYTE)), (WORD, bpe.PairIndexBpe(WORD))):
        theirs = Tokenizer.from_file(path)
        ids, counts = ours.encode(ODD_TEXTS * 2)
        for t, part in zip(ODD_TEXTS * 2, np.split(ids, np.cumsum(counts)[:-1])):
            assert part.tolist() == theirs.encode(t or "", add_special_tokens=False).ids, t
            if path == WORD:
                assert ours.decode(part.tolist()) == theirs.decode(part.tolist(), skip_special_tokens=False)


def test_token_counts(spark):
    from tokenizers import Tokenizer

    rows = [(i, t) for i, t in enumerate([*ODD_TEXTS, "one\ntwo\n", "\n\n"])]
    tokenizer = Tokenizer.from_file(BYTE)
    for rule in ("start", "end"):
        got = token_count.section_counts(frame(spark, rows), BYTE, rule=rule).collect()
        for i, t in rows:
            own = sorted((r["section"], r["start"], r["upto"], r["n_tokens"]) for r in got if r["doc_id"] == i)
            assert sum(x[3] for x in own) == len(tokenizer.encode(t or "", add_special_tokens=False).ids)
            assert "".join((t or "")[a:b] for _, a, b, _ in own) == (t or "")
            assert len(own) == max(1, len(re.findall(r"[^\n]*\n|[^\n]+$", t or "")))


def test_token_orc(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = [(i * 3, t) for i, t in enumerate(ODD_TEXTS * 3)]
    token_orc.write_orc(frame(spark, rows), f"file://{tmp_path}/t", BYTE, files=4)
    start, tokenizer = 0, Tokenizer.from_file(BYTE)
    for r, (i, t) in zip(sorted(token_orc.read_index(spark, f"file://{tmp_path}/t").collect()), rows, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_orc.read_documents(spark, f"file://{tmp_path}/t", [3]).count() == 1


def test_decontamination(spark):
    rows = passages(8, 200)
    items = [(i, " ".join((t or "").split()[3 : 3 + n])) for (i, t), n in zip(rows[:60], [0, 1, 4, 9, 10, 11, 30] * 9)] + [(900, None)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for most in (200_000, 1):
        decontam.BROADCAST_ROWS, before = most, decontam.BROADCAST_ROWS
        got = decontam.find_contamination(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
        decontam.BROADCAST_ROWS = before
        assert len(got) == len(rows)
        for r in got:
            w = words(dict(rows)[r["doc_id"]])
            found = [(k, n, windows[g]) for n in {len(g) for g in windows} for k in range(len(w) - n + 1) if (g := tuple(w[k : k + n])) in windows]
            hit = {k + j for k, n, _ in found for j in range(n)}
            assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(set().union(*(s for *_, s in found)) if found else []))


def test_suffix_dedup(spark):
    lines = "a line that its own text repeats over and over, 60 bytes long\n" * 12
    own = ["".join(random.Random(k).choices("abcdefgh ", k=900)) for k in range(3)]
    rows = [*passages(9, 150), (7, "y" * 450), (7, "y" * 450), (None, passages(9, 150)[3][1]), (300, lines + own[0] + lines + own[1]), (301, own[2] + lines + "z"), (302, lines[:500])]
    seen = Counter(b[p : p + 400] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - 399))
    expected = Counter()
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 399):
            if seen[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        expected[i, len(b), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()] += 1
    for hot in (1000, 1):
        suffix_dedup.HOT, before = hot, suffix_dedup.HOT
        got = suffix_dedup.remove_repeats(frame(spark, rows)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
        suffix_dedup.HOT = before
        assert Counter(map(tuple, got)) == expected
    assert suffix_dedup.remove_repeats(frame(spark, rows).limit(0)).count() == 0


def test_repeated_passages(spark):
    """Passages of 51 words go, though under 400 bytes; those of 50 stay; so do the cuts of 400 bytes."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefghé", k=r.randint(1, 6)))
    base = [[word() for _ in range(n)] for n in (50, 51, 53, 120)]
    rows = [(i, " ".join([*(word() for _ in range(r.randint(0, 40))), *base[i % 4], *(word() for _ in range(r.randint(0, 40)))])) for i in range(40)]
    rows += [(40, "\n\t".join(base[1])), (41, " ".join(base[0])), (42, "x" * 450), (43, "x" * 399), (44, "a " * 60), (45, None), (46, " "), (47, rows[1][1]), (47, rows[1][1]), (48, "日本" * 200), (49, "日本" * 200)]
    found = {i: list(re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in enumerate(t for _, t in rows)}
    seen = Counter(tuple(m[0] for m in w[k : k + 51]) for w in found.values() for k in range(len(w) - 50))
    strings = Counter(b[p : p + 400] for _, t in rows for b in [(t or "").encode()] for p in range(len(b) - 399))
    expected = Counter()
    for (i, t), w in zip(rows, found.values()):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(w) - 50):
            if seen[tuple(m[0] for m in w[k : k + 51])] > 1:
                gone[w[k].start() : w[k + 50].end()] = True
        for p in range(len(b) - 399):
            if strings[b[p : p + 400]] > 1:
                gone[p : p + 400] = True
        expected[i, bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore") if gone.any() else t] += 1
    assert expected[41, rows[41][1]] == 1 and expected[40, ""] == 1
    for hot in (1000, 1):
        suffix_dedup.HOT, before = hot, suffix_dedup.HOT
        got = suffix_dedup.dedup_texts(frame(spark, rows), words=51).collect()
        suffix_dedup.HOT = before
        assert Counter(map(tuple, got)) == expected


def test_pipeline(spark):
    import os

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, d).cache()
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    assert corpus_pipeline.run(spark, d).count() == n
