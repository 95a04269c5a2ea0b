"""What the operators' docstrings define for clashing columns, empty tables, repeated rows, null ids and a very long text; and the files of the ORC writer."""

import hashlib
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyarrow import orc
from pyspark.sql import functions as F

from orbweave.llm import bpe, common, decontam, jaccard, neardup, quality, queries, sharding, suffix_dedup, token_count, token_orc, url_filter

pytest.importorskip("public_tokenizers")
BYTE, WORD = queries.tokenizer_path("byte_bpe_50k.json"), queries.tokenizer_path("word_bpe_49k.json")
LOW = {i: i + 32 for i in range(65, 91)}
CLASHES = ["Score", "_text", "Size", "_cell", "_a", "IDS", "_t", "text_", "gone", "_gone", "span_id", "N_bytes", "key", "Kept", "a b", "cell"]


def words(r, n):
    return " ".join("".join(r.choices("abcdefgh", k=r.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with clashing columns, a null id, nulls, an empty text, repeated rows and a text of over 1 MB."""
    r = random.Random(2)
    long, passage = words(r, 230_000), words(r, 80)
    texts = [None, "", "one", "Two words\nand\ttwo", long, long + " end", passage + " x", "y " + passage, "it's <|endoftext|> é", "it's <|endoftext|> é"]
    rows = [(None if i == 2 else 5 if i == 9 else i, t, *["own"] * len(CLASHES)) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], rows[9]]
    return spark.createDataFrame(rows, f"doc_id long, text string, {', '.join(f'`{c}` string' for c in CLASHES)}").repartition(3).cache()


def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def own_columns(df, *outputs):
    kept = [c for c in CLASHES if c.lower() not in {o.lower() for o in outputs}]
    assert set(kept) <= set(df.columns) and len({c.lower() for c in df.columns}) == len(df.columns)
    return df


def test_quality(spark, docs):
    net = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int"))
    scored = own_columns(quality.score(docs, net), "score").collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    kept = quality.keep_good(docs, net, 0.0)
    assert kept.columns == docs.columns and Counter(plain(kept)) == Counter(plain(docs))
    assert quality.keep_good(docs, net, 1.1).count() == 0 and quality.score(docs.limit(0), net).count() == 0


def test_quality_fit_is_bounded_by_whole_texts(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    quality.SAMPLE_BYTES, before = 100_000, quality.SAMPLE_BYTES
    try:
        quality.train(docs, labels)  # without the two long texts
    finally:
        quality.SAMPLE_BYTES = before


def test_sharding(spark, docs):
    for hot in (10_000, 1):  # with 1, equal rows are dealt by their stored places
        sharding.HOT, before = hot, sharding.HOT
        rows = own_columns(sharding.shard(docs, 4), *sharding.OUTPUTS).collect()
        sharding.HOT = before
        assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(plain(docs))
        sizes = Counter(r["shard"] for r in rows)
        assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    same = docs.limit(1).crossJoin(spark.range(400)).drop("id")
    sharding.HOT, before = 10, sharding.HOT
    assert set(Counter(r["shard"] for r in sharding.shard(same, 8).collect()).values()) == {50}
    sharding.HOT = before


def test_large_hypergeometric():
    rng = np.random.default_rng(1)
    for good, bad, drawn in ((700_000_000, 900_000_000, 10_000), (1_500_000_000, 3, 40), (5, 2_000_000_000, 1_000_000_000)):
        got = np.array([sharding.hypergeometric(rng, good, bad, drawn) for _ in range(300)])
        mean = drawn * good / (good + bad)
        assert got.min() >= max(0, drawn - bad) and got.max() <= min(drawn, good) and abs(got.mean() - mean) < 5 * (1 + mean * bad / (good + bad)) ** 0.5 / 300**0.5
    assert abs(np.mean([sharding.hypergeometric(rng, 5, 2_000_000_000, 1_000_000_000) for _ in range(2000)]) - 2.5) < 0.15


def test_uniform_shuffle(spark):
    """Each row goes to each shard about equally often over seeds."""
    small = spark.createDataFrame([(i, "t") for i in range(12)], "doc_id long, text string").cache()
    seen = Counter((r["doc_id"], r["shard"]) for seed in range(24) for r in sharding.shard(small, 3, seed=seed).collect())
    assert len(seen) == 36 and max(seen.values()) <= 18


def test_embeddings(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (4, [1.0, 0.01]), (9, [1.0, 0.01]), (9, [0.0, 1.0]), (7, None), (8, [5.0])]
    df = spark.createDataFrame([(*x, "own", "own") for x in rows], "vec_id long, embedding array<double>, K string, rep string")
    got = Counter(map(tuple, neardup.near_duplicates(df).collect()))
    assert got == Counter([(None, 3, 4), (None, 3, 4), (4, 3, 4), (9, 3, 4), (9, 0, 9), (7, 0, 7), (8, 0, 8)])
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(TypeError):
        neardup.near_duplicates(df.withColumn("vec_id", F.lit("x")))


def test_jaccard(spark, docs):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in jaccard.similar_groups(docs).collect()}
    long = [(k, c) for k, c in got.items() if k[1] > 100_000]
    assert len(long) == 2 and {c for _, c in long} == {4} and got[0, 0] == 0 and got[1, 0] == 1
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns and Counter(plain(kept)) == Counter(x for x in plain(docs) if x[0] not in (5, 7, 8))
    assert jaccard.similar_groups(docs.limit(0)).count() == 0
    with pytest.raises(TypeError):
        jaccard.similar_groups(docs.withColumn("doc_id", F.lit("x")))


def test_sections(spark, docs):
    """Counts and crossings of each section against the library's offsets."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE)
    rows = [(i, t) for i, t in enumerate(["one\ntwo\n\n\nthree  \n x", "é\n日本\n", "a" * 50 + "\n" + "b" * 50, "", None, "\n", "x\n\n\n\n\ny"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for rule in ("start", "end"):
        got = {(r["doc_id"], r["section"]): (r["start"], r["upto"], r["n_tokens"], r["n_crossing"]) for r in token_count.section_counts(df, BYTE, rule=rule).collect()}
        for i, t in rows:
            ends = [m.end() for m in re.finditer("\n", t or "")]
            ends += [len(t)] if t and (not ends or ends[-1] < len(t)) else []
            ends = ends or [0]
            raw = [len((t or "")[:e].encode()) for e in ends]
            tokens, crossing, at = Counter(), Counter(), 0
            for k in tokenizer.encode(t or "", add_special_tokens=False).ids:
                n = len(tokenizer.id_to_token(k))
                first, last = (sum(e <= p for e in raw) for p in (at, at + n - 1))
                tokens[first if rule == "start" else last] += 1
                crossing[first if rule == "start" else last] += first != last
                at += n
            for s, (a, b) in enumerate(zip([0, *ends], ends)):
                assert got.pop((i, s)) == (a, b, tokens[s], crossing[s])
        assert not got
    assert token_count.section_counts(docs, BYTE).filter("doc_id = 4").agg(F.sum("n_tokens")).first()[0] == len(tokenizer.encode(dict(plain(docs))[4], add_special_tokens=False).ids)
    assert token_count.section_counts(docs.limit(0), BYTE).count() == 0


def _message(data: bytes) -> dict:
    """The fields of a protocol buffer message: numbers or bytes."""
    out, at = {}, 0

    def number():
        nonlocal at
        n = shift = 0
        while True:
            n |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return n

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            value = number()
        else:
            size = number() if tag & 7 == 2 else 8
            value, at = data[at : at + size], at + size
        out.setdefault(tag >> 3, []).append(value)
    return out


def _unpacked(data: bytes) -> bytes:
    import zstandard

    out = b""
    while data:
        head = int.from_bytes(data[:3], "little")
        part, data = data[3 : 3 + (head >> 1)], data[3 + (head >> 1) :]
        out += part if head & 1 else zstandard.ZstdDecompressor().decompressobj().decompress(part)
    return out


def test_orc_files(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    path = f"file://{tmp_path}/t"
    token_orc.write_orc(docs, path, BYTE, files=5)
    tokenizer, inside = Tokenizer.from_file(BYTE), {}
    expected = Counter()
    for i, t in plain(docs):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        expected[i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    index = token_orc.read_index(spark, path).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in index) == expected
    # what a reader finds at a start is the document, also where an id has several rows
    flat, ids_so_far = [], []
    for f in sorted(Path(f"{tmp_path}/t").glob("*.orc"), key=lambda f: f.name):
        table = orc.ORCFile(f).read()
        flat += [x for ids in table.column("ids").to_pylist() for x in ids]
        ids_so_far += table.column("doc_id").to_pylist()
        data = f.read_bytes()
        post = _message(data[-1 - data[-1] : -1])
        footer = _message(_unpacked(data[-1 - data[-1] - post[1][0] : -1 - data[-1]]))
        for s in map(_message, footer[3]):
            begin = s[1][0] + s[2][0] + s[3][0]
            stripe = _message(_unpacked(data[begin : begin + s[4][0]]))
            kinds = {(x[2][0], x[1][0]) for x in map(_message, stripe[1])}
            # columns: 0 the row, 1 part, 2 doc_id, 3 n_tokens, 4 ids_crc32, 5 ids, 6 their items; streams: 6 row index, 8 Bloom filter; encoding 2: run lengths, version 2
            assert {(c, 6) for c in range(7)} <= kinds and (2, 8) in kinds and not (6, 8) in kinds
            encodings = [_message(e).get(1, [0])[0] for e in stripe[2]]
            assert encodings[2] == encodings[6] == 2
            inside[f.name] = True
    assert len(inside) > 1 and ids_so_far == sorted(ids_so_far, key=lambda x: -1 if x is None else x)
    for r in index:
        assert zlib.crc32(np.array(flat[r["start"] : r["start"] + r["n_tokens"]], "<u4").tobytes()) == r["ids_crc32"]
    token_orc.write_orc(docs.limit(0), f"file://{tmp_path}/none", BYTE)
    assert token_orc.read_index(spark, f"file://{tmp_path}/none").count() == 0


def test_orc_frequent_id(spark, tmp_path):
    """Rows of one id that fill several ranges, all of one text: dealt to all of these, with starts that tile the file."""
    rows = [(i, "a b") for i in range(40)] + [(7, "same text")] * 200 + [(None, "none")] * 60
    token_orc.write_orc(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), f"file://{tmp_path}/t", BYTE, files=10)
    assert len(list(Path(f"{tmp_path}/t").glob("*.orc"))) >= 8
    index = sorted((r["start"], r["n_tokens"], -1 if r["doc_id"] is None else r["doc_id"]) for r in token_orc.read_index(spark, f"file://{tmp_path}/t").collect())
    assert len(index) == 300 and all(a + n == b for (a, n, _), (b, _, _) in zip(index, index[1:])) and [x[2] for x in index] == sorted(x[2] for x in index)


def test_orc_lookup_reads_few_rows(spark, tmp_path):
    """Statistics, row index and Bloom filters keep a lookup from reading the table."""
    df = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    path = f"file://{tmp_path}/t"
    token_orc.write_orc(df, path, BYTE, files=2)

    def rows_read(ids):
        found = token_orc.read_documents(spark, path, ids)
        n = len(found.collect())
        scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
        return n, scan.metrics().apply("numOutputRows").value()

    assert rows_read([20_000]) == (1, 1000) and rows_read([20_001])[1] <= 1000


def test_bpe(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    own_columns(bpe.encode(docs, WORD, round_trip=True), "ids", "decoded")
    digest = queries.bpe_digest(docs, WORD)
    expected = Counter()
    for i, t in plain(docs):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        expected[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, digest.collect())) == expected
    assert bpe.encode(docs.limit(0), WORD).count() == 0 and bpe.decode(bpe.encode(docs, WORD), WORD).count() == docs.count()


def test_decontamination(spark, docs):
    passage = dict(plain(docs))[6]
    items = spark.createDataFrame([(1, passage[:200], "own"), (2, "two words", "own"), (3, None, "own"), (4, "", "own")], "item_id long, text string, gram string")
    rows = decontam.find_contamination(docs, items).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in plain(docs)) and {r["doc_id"]: r["items"] for r in rows if r["n_hit"]} == {3: ["2"], 6: ["1"], 7: ["1"]}
    kept = decontam.remove_contaminated(docs, items)
    assert kept.columns == docs.columns and Counter(plain(kept)) == Counter(x for x in plain(docs) if x[0] not in (3, 6, 7))
    assert decontam.remove_contaminated(docs, items.limit(0)).count() == docs.count() and decontam.find_contamination(docs.limit(0), items).count() == 0


def test_repeats(spark, docs):
    rows = own_columns(suffix_dedup.remove_repeats(docs, words=51), *suffix_dedup.OUTPUTS, "n_passage_words").collect()
    assert len(rows) == docs.count()
    by_id = {r["doc_id"]: r for r in rows if r["n_bytes"]}
    long = len(dict(plain(docs))[4])
    assert by_id[4]["n_removed"] == long == by_id[5]["n_removed"] if by_id[5]["n_bytes"] > 1000 else by_id[4]["n_removed"] == long
    assert by_id[6]["n_passage_words"] == by_id[7]["n_passage_words"] == 80 and by_id[3]["n_passage_words"] == 0 and by_id[4]["n_passage_words"] == 230_000
    text_ids = suffix_dedup.remove_repeats(docs.withColumn("doc_id", F.concat(F.lit("x"), F.col("doc_id")))).collect()
    assert sorted((r["n_bytes"], r["n_removed"], r["kept"]) for r in text_ids) == sorted((r["n_bytes"], r["n_removed"], r["kept"]) for r in rows)
    cut = suffix_dedup.dedup_texts(docs, words=51)
    assert cut.columns == docs.columns and {r["doc_id"]: r["text"] for r in cut.collect()}[6] == " x"
    assert suffix_dedup.remove_repeats(docs.limit(0), words=51).count() == 0 and suffix_dedup.dedup_texts(docs.limit(0), words=51).count() == 0


def test_url_rules_as_a_table(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, ("n", None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.example.com/en/x", "own"), (2, None, "own"), (3, "http://net/fr/", "own")] * 2, "page_id long, url string, RULE string")
    got = Counter((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, rules).collect())
    assert got == Counter({(1, "example.com/en/", "block"): 2, (2, None, "allow"): 2, (3, "net/fr/", "block"): 2})


def test_intermediate_tables_go(spark, docs):
    common.clear_stored(spark)
    jaccard.similar_groups(docs).count()
    assert len(common._MADE.paths) == 2  # what the result reads
    common.clear_stored(spark)
    assert not common._MADE.paths


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage's kept ids and texts, and run()'s digests, on a small fixture."""
    from tokenizers import Tokenizer

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(6)
    passage, item = words(r, 60), words(r, 40)
    good = [words(r, r.randint(80, 200)) for _ in range(120)]
    texts = good + [" ".join(good[k].split()[:-1] + ["changed"]) for k in range(10)] + good[10:14]
    texts += [f"{words(r, 90)} {passage} {words(r, 70)}" for _ in range(6)] + [f"{words(r, 50)} {item[:120]} {words(r, 50)}" for _ in range(5)]
    bad = ["".join(r.choices("@#$%^&*0123456789!?", k=r.randint(200, 900))) for _ in range(60)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, *bad])] + [(900, None, None, None, None), (901, "", "en", "s", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(texts)), 0) for i, *_ in rows[:-2] if i % 3], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").coalesce(1).write.parquet(f"{d}/benchmark.parquet")
    docs, now = spark.read.parquet(f"{d}/documents.parquet"), {i: t for i, t, *_ in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k == 4:
            break
        assert out.columns == docs.columns
        docs = out.cache()
        got = {x["doc_id"]: x["text"] for x in docs.collect()}
        if k == 0:  # learned: the rejected are those whose score is under 0.3
            net = quality.train(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
            scores = {x["doc_id"]: x["score"] for x in quality.score(spark.read.parquet(f"{d}/documents.parquet"), net).collect()}
            now = {i: t for i, t in now.items() if scores[i] >= 0.3}
            assert set(range(len(texts))) <= set(now) and not set(range(len(texts), len(texts) + 60)) & set(now)
        elif k == 1:
            sets = {}
            for i, t in now.items():
                w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
                sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
            least = {i: i for i in now}
            for i in sorted(now):
                for j in sorted(now):
                    if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        a, b = sorted((least[i], least[j]))
                        least = {x: a if y == b else y for x, y in least.items()}
            assert len(set(least.values())) < len(now) - 10
            now = {i: t for i, t in now.items() if least[i] == i}
        elif k == 2:
            found = {i: list(re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in now.items()}
            seen = Counter(tuple(m[0] for m in w[j : j + 51]) for w in found.values() for j in range(len(w) - 50))
            strings = Counter(b[p : p + 400] for t in now.values() for b in [(t or "").encode()] for p in range(len(b) - 399))
            for i, w in found.items():
                b = (now[i] or "").encode()
                gone = np.zeros(len(b), bool)
                for j in range(len(w) - 50):
                    if seen[tuple(m[0] for m in w[j : j + 51])] > 1:
                        gone[w[j].start() : w[j + 50].end()] = True
                for p in range(len(b) - 399):
                    if strings[b[p : p + 400]] > 1:
                        gone[p : p + 400] = True
                if gone.any():
                    now[i] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
            assert not any(passage in (t or "") for t in now.values())
        elif k == 3:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", item)
            windows = {" ".join(w[j : j + 10]) for j in range(len(w) - 9)}
            hit = {i for i, t in now.items() if any(f" {x} " in f" {' '.join(re.findall(r'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+', (t or '').translate(LOW)))} " for x in windows)}
            assert len(hit) == 5
            now = {i: t for i, t in now.items() if i not in hit}
        assert got == now, name
    tokenizer = Tokenizer.from_file(WORD)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    expected = set()
    for i, t in now.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        expected.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert set(map(tuple, corpus_pipeline.run(spark, d).collect())) == expected
