"""The ten operators against the libraries, brute force and held-out labels; nulls, empty and long texts, repeats, empty tables, clashing names."""

import base64
import ctypes
import glob
import gzip
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

from corpusmill.llm import bpe, folds, language_id, packing, quality_classifier, quality_rules, queries, sharding, simhash, token_counts, warc, winnowing
from corpusmill.scratch import fresh_path

BYTE, WORD = public_tokenizers.path(queries.BYTE_BPE), public_tokenizers.path(queries.WORD_BPE)
ODD = [
    None,
    "",
    "   \n\t ",
    "The cat's 12 hats, naïve café!",
    "The cat's 12 hats, naïve café!",
    "a  b   c \n\n d <|endoftext|> e<|startoftext|>f",
    "ΣΑΣ İstanbul ́x  y 你好，世界 🙂",
    "word " * 30_000,
    "x" * 50_000,
    "one two",
    "$$$ ### |",
]
SCHEMA = "doc_id long, text string, n_tokens string, row string, word string, block long, id long, kept int, _text string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", "clash", "w", 7, 8, 9, "t") for i, t in enumerate(ODD)] + [(None, "no id", *(None,) * 7), (3, ODD[3], *(None,) * 7)]
    path = fresh_path(spark, "odd")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def same(rows, expected):
    assert sorted(map(repr, rows)) == sorted(map(repr, expected))


def test_bpe(odd, empty):
    t = Tokenizer.from_file(WORD)
    got = bpe.decode(bpe.encode(odd, WORD, stable=True, block_bytes=20_000), WORD).collect()
    expected = []
    for r in odd.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), np.array(ids, "<u4").tobytes(), t.decode(ids, skip_special_tokens=False)))
    same([(r.doc_id, r.n_tokens, bytes(r.ids), r.decoded) for r in got], expected)
    assert bpe.encode(empty, WORD).count() == 0


def test_token_counts(odd, empty):
    t = Tokenizer.from_file(BYTE)
    expected = [(r.doc_id, len((r.text or "").encode()), len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()]
    for rows in (0, 3, 1000):  # the frequent tier never changes a count
        same([tuple(r) for r in token_counts.count_tokens(odd, BYTE, table_rows=rows).collect()], expected)
    assert token_counts.count_tokens(empty, BYTE).count() == 0


def test_packing(odd, empty, spark):
    t = Tokenizer.from_file(BYTE)
    got = packing.pack_documents(odd, BYTE, end_id=1).collect()
    texts = Counter(tuple(t.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in odd.collect())
    by_doc: dict = {}
    for r in got:
        assert r.length == len(r.ids) // 4 and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in got) == sum(len(k) * n for k, n in texts.items())
    for (doc_id, n), pieces in by_doc.items():
        starts = Counter(p.start for p in pieces)
        copies = starts[0]
        assert sum(p.length for p in pieces) == n * copies and set(starts.values()) == {copies}
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty, BYTE, end_id=1).count() == 0


def test_cuts():
    for n in range(1, 5000):
        parts = packing.cuts(n, 2048)
        assert sum(parts) == n and max(parts) <= 2048 and len(parts) <= n // 2048 + 6


def test_full_bins_hold_a_fixed_count(spark):
    pieces = spark.range(5000).select(F.col("id").alias("row"), F.lit(0).cast("long").alias("start"), (F.col("id") % 700 + 300).alias("length"))
    got = packing.harmonic_pack(pieces).where("sequence_id >= (1L << 40)").collect()
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r.length)
    assert bins and all(len(b) == s >> 40 and {2048 // x for x in b} == {s >> 40} for s, b in bins.items())


def gram_hash(chars, k):
    """Spark's xxhash64 folded over k signs by doubling; nothing is hashed beyond the end."""

    def both(*values):
        seed = 42
        for v in values:
            if v is not None:
                seed = xxh64_intdigest(v.encode() if isinstance(v, str) else np.array([v], "<i8").tobytes(), seed)
        return ctypes.c_int64(seed).value

    x, reach = list(chars), 1
    while reach < k:
        step = min(reach, k - reach)
        x, reach = [both(v, x[i + step] if i + step < len(x) else None) for i, v in enumerate(x)], reach + step
    return x[0]


def brute_winnow(text, k=winnowing.GRAM, window=winnowing.WINDOW):
    """Least hash of each window, the rightmost of equals, by position."""
    text, known = text or "", {}
    parts = [text[i : i + k] for i in range(max(len(text) - k + 1, min(len(text), 1)))]
    for part in parts:
        if part not in known:
            known[part] = gram_hash(part, k) >> 32
    grams = [known[part] for part in parts]
    out = []
    for i in range(max(len(grams) - window + 1, min(len(grams), 1))):
        j = min(range(i, min(i + window, len(grams))), key=lambda j: (grams[j], -j))
        if not out or (grams[j], j) != out[-1]:
            out.append((grams[j], j))
    return out


def chosen(fingerprint):
    return [(x >> 31, (1 << 31) - 1 - (x & ((1 << 31) - 1))) for x in fingerprint]


def test_winnowing(spark):
    texts = [t for t in ODD if t is None or len(t) < 1000] + ["a b a b a b a b a b a b a b a b" * 4, "lorem ipsum dolor sit amet " * 9, "你好世界" * 30]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows.select("doc_id", winnowing.winnow(F.col("text")).alias("f")).select("doc_id", "f", winnowing.positions(F.col("f")).alias("p")).collect()
    for r in got:
        assert chosen(r.f) == brute_winnow(texts[r.doc_id]) and r.p == [p for _, p in chosen(r.f)]


def test_a_shared_passage_gives_a_common_hash_after_any_shift(spark):
    rng = np.random.default_rng(11)
    signs = lambda n: "".join(map(chr, rng.integers(0x4E00, 0x9FA0, n)))
    passage = signs(winnowing.GRAM + winnowing.WINDOW - 1)  # no blanks anywhere
    texts = [signs(shift) + passage + signs(rng.integers(0, 50)) for shift in range(40)]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(winnowing.hashes(winnowing.winnow(F.col("t"))).alias("h")).collect()
    assert set.intersection(*(set(r.h) for r in found))


def test_edited_by_next(odd, empty, spark):
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(50)]
    long = [" ".join(rng.choice(words, n)) for n in (30, 80, 200, 400)]
    rows = [(i, t) for i, t in enumerate([t for t in ODD if t is None or len(t) < 1000] + long + [long[0], "x" + long[2]])]
    path = fresh_path(spark, "unique")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    texts = [t or "" for _, t in rows]
    got = winnowing.edited_by_next(spark.read.parquet(path)).orderBy("doc_id").collect()
    assert len(got) == len(texts)

    def likeness(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, r in enumerate(got):
        after, cut = texts[(i + 1) % len(texts)], len(texts[i]) // 4
        edited = texts[i][: len(texts[i]) - cut] + after[:cut]
        own, other, new = brute_winnow(texts[i]), brute_winnow(edited), brute_winnow(after)
        assert r.edited_text == edited and r.n_chars == len(texts[i])
        assert chosen(r.fingerprint) == own and chosen(r.edited_fingerprint) == other
        assert r.near_edited == pytest.approx(likeness(own, other)) and r.near_next == pytest.approx(likeness(own, new))
    assert winnowing.edited_by_next(odd).count() == len(ODD) + 2
    assert winnowing.edited_by_next(empty).count() == 0


def test_next_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7 % 5003).alias("k"), F.col("id").cast("string").alias("v"))
    got = winnowing.with_next(rows, "k", F.col("k"), "after", range_rows=100).collect()
    keys = sorted(r.k for r in got)
    after = dict(zip(keys, keys[1:] + keys[:1]))
    assert len(got) == 5000 and all(after[r.k] == r.after for r in got)


def test_next_where_many_rows_have_one_id(spark):
    n = F.col("id")
    rows = spark.range(3000).select(F.when(n % 3 == 0, n).when(n % 3 == 1, F.lit(1500)).alias("k"), n.alias("v"))
    got = winnowing.with_next(rows, "k", F.col("v"), "after", range_rows=50).collect()
    # the rows form one circle through all values, ids ascending, null first
    at, seen, keys = {r.v: r for r in got}, [], []
    v = min(r.v for r in got)
    for _ in range(3000):
        seen.append(v)
        keys.append(-1 if at[v].k is None else at[v].k)
        v = at[v].after
    assert sorted(seen) == list(range(3000)) and v == seen[0]
    assert sum(a > b for a, b in zip(keys, keys[1:] + keys[:1])) == 1


@pytest.mark.parametrize("version", [1, 2])
def test_warc(spark, version):
    html = [None, "", "<p>\r\n\r\nWARC/1.1\r\n</p>", "<p>é</p>", "<p>é</p>", "x" * 100_000, "x" * 100_000]
    pages = [(i + 1, f"http://a.example/{i} b" if i else None, h, "clash") for i, h in enumerate(html)] + [(9, "", "<p>é</p>", None)]
    arcs, warcs = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    warc.write_arc(spark.createDataFrame(pages, "page_id long, url string, html string, payload string").repartition(3), arcs, "page_id", "url", "html", version)
    warc.convert(spark, arcs, warcs)
    got = {int(r.source_id): r for r in warc.read_warc(spark, warcs).where("source_id is not null").collect()}
    first: dict = {}
    for i, _, h, _ in pages:
        first.setdefault(h or "", i)
    for i, url, h, _ in pages:
        data, r = (h or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to_id) == (("response", None) if first[h or ""] == i else ("revisit", str(first[h or ""])))
        assert r.uri == (url or "unknown:").replace(" ", "%20") and r.ts == "2024-01-01T00:00:00Z"
    assert warc.read_warc(spark, warcs).where("record_type = 'warcinfo'").count() >= 1
    for file in glob.glob(warcs.removeprefix("file://") + "/part-*"):  # a gzip member is a record
        data = open(file, "rb").read()
        while data:
            member = zlib.decompressobj(31)
            record = member.decompress(data)
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and record.count(b"\r\nWARC-Record-ID: ") == 1
            data = member.unused_data


def test_warc_of_nothing_and_of_a_long_page(spark):
    schema = "page_id long, url string, html string"
    arcs, warcs = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    warc.write_arc(spark.createDataFrame([], schema), arcs, "page_id", "url", "html")
    warc.convert(spark, arcs, warcs)
    assert warc.read_warc(spark, warcs).where("record_type <> 'warcinfo'").count() == 0
    long = "é" * (9 << 20)  # more than 16 MB
    arcs, warcs = fresh_path(spark, "arc"), fresh_path(spark, "warc")
    warc.write_arc(spark.createDataFrame([(5, "u", long), (None, None, "n"), (2, "u", long), (None, "u", "n")], schema).repartition(2), arcs, "page_id", "url", "html")
    warc.convert(spark, arcs, warcs)
    got = warc.read_warc(spark, warcs).where("record_type <> 'warcinfo'").select("source_id", "record_type", "payload_bytes", "refers_to_id").collect()
    same([tuple(r) for r in got], [("2", "response", 18 << 20, None), ("5", "revisit", 18 << 20, "2"), (None, "response", 1, None), (None, "revisit", 1, None)])


def test_arc_records():
    body = b"HTTP/1.0 200 OK\r\n\r\nhi"
    v2 = b"filedesc://x 0.0.0.0 20000101000000 text/plain 200 - - 0 x 9\n2 0 test\n\nhttp://a/ b 1.2.3.4 20010203040506 text/html 200 c l 0 x %d\n%s\ndns:a 1.2.3.4 20010203040506 text/dns 200 - - 0 x 2\nok\nno header\n" % (len(body), body)
    got = [(f["url"], b) for _, f, b in warc.arc_records(gzip.compress(v2))]
    assert got == [("filedesc://x", b"2 0 test\n"), ("http://a/ b", body), ("dns:a", b"ok")]
    record = warc._record("x", 0, {"url": "dns:a", "date": "20010203040506", "type": "text/dns"}, b"ok")
    assert (record["record_type"], record["ts"], record["content_type"]) == ("resource", "2001-02-03T04:05:06Z", "text/dns")


def test_quality_rules(odd, empty, spark):
    trusted = spark.createDataFrame([(3,), (3,), (None,)], "trusted_id long")
    got = quality_rules.quality_rules(odd, trusted, prefix="q_")
    assert got.columns[: len(odd.columns)] == odd.columns and got.count() == odd.count()
    word = re.compile(r"[^\x20\x09-\x0D]+")
    for r in got.collect():
        text = r.text or ""
        w = word.findall(text)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if windows[g] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if word.search(x)]
        assert (r.q_n_words, r.q_word_chars, r.q_n_symbols, r.q_n_dup_lines, r.q_n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r.q_base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r.q_kept and r.q_base_failed) and (r.q_llr is None) == r.q_base_failed
    clash = odd.withColumn("counts", F.lit("mine")).withColumn("q_counts", F.lit("mine")).withColumn("_COUNTS", F.lit("mine"))
    kept = quality_rules.quality_rules(clash, trusted, prefix="q_")
    assert {tuple(r) for r in kept.select("counts", "q_counts", "_counts").distinct().collect()} == {("mine",) * 3}
    assert quality_rules.quality_rules(empty, trusted).count() == 0


def test_llr_equals_brute_force(spark):
    texts = ["good text is good " + " ".join(map(str, range(50, 110))), "bad bad ### ### " * 20, "good bad " * 5 + " ".join(map(str, range(90))), ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = spark.createDataFrame([(0,)], "trusted_id long")
    bits = 8

    def longs(text):
        return [xxh64_intdigest(t, 42) for t in re.findall(r"[^\W_]+|[^\s\w]+", text)]

    def buckets(text):
        h = longs(text)
        out = [x & 255 for x in h]
        for i, x in enumerate(h):
            seed = xxh64_intdigest(np.array([x], "<u8").tobytes(), 42)
            if i + 1 < len(h):
                seed = xxh64_intdigest(np.array([h[i + 1]], "<u8").tobytes(), seed)
            out.append(seed & 255)
        return out

    raw, good = Counter(b for t in texts for b in buckets(t)), Counter(buckets(texts[0]))
    nr, nt = sum(raw.values()), sum(good.values())
    ratio = {b: np.log((good[b] + 1) / (nt + 256)) - np.log((raw[b] + 1) / (nr + 256)) for b in range(256)}
    found = quality_rules.quality_rules(docs, trusted, bits=bits).collect()
    got, failed = {r.doc_id: r.llr for r in found}, {r.doc_id: r.base_failed for r in found}
    assert list(failed.values()).count(False) >= 2
    for i, t in enumerate(texts):
        b = buckets(t)
        assert (got[i] is None) == failed[i]
        assert failed[i] or got[i] == pytest.approx(sum(ratio[x] for x in b) / max(len(b), 1), abs=1e-12)


def test_language_id(spark, sf_dir, odd, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs.where(~folds.held_out("doc_id")), "doc_id", "text", "lang")
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    held = docs.where(folds.held_out("doc_id")).collect()
    assert np.mean([got[r.doc_id].lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    undecided = {r.doc_id: r.lang_pred for r in language_id.predict(odd, model).collect()}
    assert [undecided[i] for i in (0, 1, 2, 10)] == ["und"] * 4 and undecided[3] in model["langs"]
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.train(empty.withColumn("lang", F.lit("en")), "doc_id", "text", "lang")
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}


def test_a_second_model_and_clashing_names(spark):
    schema = "id long, t string, l string"
    train = lambda swap: language_id.train(spark.createDataFrame([(i, "eins zwei drei" if i % 2 else "one two three", "ab"[(i + swap) % 2]) for i in range(20)], schema), "id", "t", "l")
    docs = spark.createDataFrame([(1, "one two", "mine", "mine"), (None, "one two", None, None), (1, "one two", "mine", "mine"), (2, None, None, None)], "doc_id long, text string, _lang_pred string, `_Score` string")
    for swap, expected in ((0, "a"), (1, "b"), (0, "a")):  # one after the other in the same workers
        got = language_id.predict(docs, train(swap), keep=docs.columns)
        assert got.columns == [*docs.columns, "_lang_pred_", "_score_"]
        same([(r[0], r[2], r[4]) for r in got.collect()], [(1, "mine", expected), (None, None, expected), (1, "mine", expected), (2, None, "und")])


def test_ngrams_of_whole_words(spark):
    word = "a" * 70 + "bcde"  # one word without blanks, longer than any prefix
    model = language_id.train(spark.createDataFrame([(1, word, "x"), (2, word, "x")], "id long, t string, l string"), "id", "t", "l")
    assert "bcde" in model["grams"] and "cde$" in model["grams"]


def test_language_scores_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.train(docs, "doc_id", "text", "lang")
    got = {r.doc_id: r for r in language_id.predict(docs, model).collect()}
    for r in docs.collect():
        total, n = np.zeros(len(model["langs"])), 0
        for w in re.findall(r"[^\W\d_]+", (r.text or "").lower()):
            n += 1
            if w in model["words"]:
                total += model["words"][w]
                continue
            marked, found = f"^{w}$", []
            for i in range(len(marked)):
                longest = next((marked[i : i + k] for k in range(4, 0, -1) if marked[i : i + k] in model["grams"] and i + k <= len(marked)), None)
                if longest:
                    found.append(model["grams"][longest])
            total += np.mean(found, 0) if found else 0
        if not n:
            continue
        odds = np.exp((total - total.max()) / n * min(n, 10))
        assert got[r.doc_id].lang_pred == model["langs"][int(np.argmax(odds))] and got[r.doc_id].score == pytest.approx(odds.max() / odds.sum(), rel=1e-4)


def test_backoff_prefers_longer_grams():
    model = {"langs": ["a", "b"], "max_gram": 2, "words": {"yes": np.array([-1.0, -9.0], np.float32)}, "grams": {"^z": np.array([-9.0, -1.0], np.float32), "z$": np.array([-9.0, -1.0], np.float32), "z": np.array([-1.0, -9.0], np.float32)}}
    s = language_id.Scorer(model)
    assert s.predict("yes")[0] == "a" and s.predict("z")[0] == "b" and s.predict("12 ,")[0] == "und"


def test_sharding(odd, empty, spark):
    rows = odd.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
    path = fresh_path(spark, "shards")
    got = sharding.external_shuffle(rows, ["doc_id", "text"], "size", path, bucket_bytes=20_000).collect()
    same([r.text for r in got], [r.text for r in odd.collect()])
    by_shard: dict = {}
    for r in got:
        by_shard.setdefault(r.shard, []).append(r.slot)
    counts = [len(by_shard.get(s, [])) for s in range(8)]
    assert max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    assert sharding.external_shuffle(empty.withColumn("size", F.lit(1).cast("long")), ["doc_id", "text"], "size", fresh_path(spark, "none")).count() == 0


def test_sharding_is_the_same_on_every_cluster_and_keeps_clashing_names(spark, sf_dir):
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for partitions in ("4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found.append(sorted(tuple(r) for r in queries.op8_external_shuffle(spark, sf_dir).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0]) == 200
    ids = [r[0] for r in sorted(found[0], key=lambda r: (r[5], r[4]))]  # slot, shard
    assert ids != sorted(ids) and sum(abs(i - j) for i, j in zip(ids, sorted(ids))) > 200 * 200 / 6
    rows = spark.createDataFrame([(i, "t", 1, "mine", "mine") for i in range(50)], "doc_id long, text string, Size long, Shard string, slot string")
    got = sharding.external_shuffle(rows, ["doc_id", "text"], "size", fresh_path(spark, "clash"), bucket_bytes=10)
    assert got.columns == [*rows.columns, "slot_", "shard_"]
    assert sorted(r.slot_ * 8 + r.shard_ for r in got.collect()) == list(range(50)) and {(r.Shard, r.slot) for r in got.collect()} == {("mine", "mine")}


def test_quality_decisions_at_two_sizes(spark, sf_dir):
    for size, least_good, least_bad in (("0.01", 0.9, 0.85), ("0.1", 0.9, 0.85)):
        folder = sf_dir.replace("0.001", size)
        found = queries.op9_quality_classifier(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
        good, bad = [r.predicted for r in found if r.quality == 1], [r.predicted for r in found if r.quality == 0]
        assert np.mean(good) >= least_good and 1 - np.mean(bad) >= least_bad


def test_scores_against_brute_force(spark, odd):
    rng = np.random.default_rng(3)
    weights = rng.normal(size=(1 << 10) + 1)
    got = {r.doc_id: r.score for r in quality_classifier.score(odd, weights).collect()}
    for i, text in enumerate(ODD):
        columns = quality_classifier.features(text, 10)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(weights[columns].sum() / np.sqrt(max(len(columns), 1)) + weights[-1]))))
    assert quality_classifier.scale(np.array([-2.0, -1, 1, 2]), np.array([0.0, 0, 1, 1]))[0] > 0 and quality_classifier.scale(np.ones(3), np.ones(3)) == (1.0, 0.0)


def test_quality_classifier(spark, sf_dir, odd, empty):
    big = sf_dir.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    fold = ~folds.held_out("doc_id")
    weights = quality_classifier.train(docs, labels.where(fold), "doc_id", "text", "quality")
    scored = quality_classifier.score(docs, weights).join(labels.where(~fold), "doc_id").collect()
    good, bad = [r.score for r in scored if r.quality == 1], [r.score for r in scored if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(odd, weights).collect())
    assert not quality_classifier.train(docs, labels.where("false"), "doc_id", "text", "quality").any()
    assert quality_classifier.score(empty, weights).count() == 0


def test_simhash(odd, empty, spark):
    base = [f"w{i}" for i in range(3000)]
    near = [" ".join(base[:k] + ["new"] + base[k + 1 :]) for k in range(0, 300, 10)]
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, t) for i, t in enumerate(near)] + [(None, near[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def brute(text):
        w = [x.decode() for x in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
        grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        h = [xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [brute(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    groups: dict = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    least = {k: min(x for x in v if x is not None) for k, v in groups.items()}
    same([tuple(r) for r in simhash.near_duplicates(docs).collect()], [(d, f"{prints[i]:016x}", least[root(i)]) for i, (d, _) in enumerate(rows)])
    assert simhash.near_duplicates(empty).count() == 0
    firsts = simhash.first_of_groups(odd, "doc_id", "text")
    assert firsts.columns == odd.columns and firsts.where("doc_id in (0, 1, 2)").count() == 1


def test_random_links_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.integers(-(2**63), 2**63, 40)
    values = set(map(int, centres))
    for c in centres:
        for _ in range(20):
            x = int(c)
            for bit in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= -(1 << 63) if bit == 63 else 1 << int(bit)
            values.add(x)
    values = sorted(values)
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    from corpusmill.llm.components import components

    roots = {r.node: r.root for r in components(simhash.linked(frame)).collect()}
    parent = {v: v for v in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {v: roots.get(v, v) for v in values} == {v: root(v) for v in values}
