"""The training-data operators against brute force, exact round trips and held-out labels."""

import datetime
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyarrow import orc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quireflow.llm import fingerprints, line_dedup, media, mixing, near_dedup, packing, quality, queries, sharding, token_counts, token_store, tokenization

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"w{i % 977} lorem" for i in range(30_000))
#: Nulls, empty, blank and long texts, repeated rows and ties; columns named like the operators' own.
MESSY = [
    (1, "a b c d e f", "s0", 7),
    (1, "a b c d e f", "s0", 7),
    (2, "a b c d e f", "s1", 8),
    (3, None, "s1", None),
    (4, "", None, 1),
    (5, " \n\t ", None, 1),
    (None, "x y\nz", "s0", 2),
    (None, None, None, None),
    (6, LONG, "s2", 3),
    (7, "é ñ <|endoftext|> 日本", "", 4),
    (8, "one", "s1", 0),
]
SCHEMA = "doc_id long, text string, source string, size long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def messy(spark):
    extra = ["k", "run", "pos", "part", "shard", "slot", "doc", "copies", "taken", "key", "node", "bin", "score", "n_lines", "word", "term"]
    return spark.createDataFrame(MESSY, SCHEMA).withColumns({c: F.lit(i) for i, c in enumerate(extra)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def rows(df):
    df = df[sorted(df.columns)]
    clean = lambda x: None if x is None or x != x else float(x) if isinstance(x, (int, float, np.number)) else str(x)
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert rows(queries.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(queries.SQL[name]).df())


# mixing


def test_mix_meets_targets(spark, docs):
    got = mixing.mix_sources(docs).toPandas()
    per = got.groupby("source").agg(size=("size", "sum"), source_size=("source_size", "max"), target=("target", "max"), taken=("taken", "sum"), largest=("size", "max"))
    assert (per["size"] == per["source_size"]).all() and (per["target"] <= 3 * per["size"]).all()
    assert abs(per["target"].sum() - per["size"].sum()) < 1e-6 * per["size"].sum()
    assert (abs(per["taken"] - per["target"]) <= per["largest"] / 2 + 1).all()
    assert (got["taken"] <= 3 * got["size"]).all()
    assert rows(mixing.mix_sources(docs.repartition(3)).drop("text").toPandas()) == rows(got.drop(columns="text"))


def test_mix_of_messy_rows(messy, empty):
    got = mixing.mix_sources(messy)
    assert got.count() == len(MESSY) and set(messy.columns) <= set(got.columns)
    assert got.agg(F.sum("size")).first()[0] == 6 * 3 + 3 + 60_000 + 4 + 1
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.repeated(got, ["doc_id"]).count() == got.agg(F.sum("copies")).first()[0]


def test_mix_by_brute_force(spark):
    """Many equal rows, so that the cut falls among them, null ids and sources, against the rule in plain Python."""
    rng = random.Random(19)
    table = [(rng.randrange(8), "w " * rng.choice([0, 3, 3, 7]), rng.choice(["a", "a", "a", "b", None])) for _ in range(400)]
    table += [(1, "w " * 5, "c")] * 60 + [(None, f"n{i} w", "d") for i in range(30)]
    got = mixing.mix_sources(spark.createDataFrame(table, "doc_id long, text string, source string").repartition(3), max_epochs=2.5).collect()
    assert Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(table)
    for source in ("a", "b", "c", "d", None):
        mine = [r for r in got if r["source"] == source]
        sizes = [r["size"] for r in mine]
        assert {r["source_size"] for r in mine} == {sum(sizes)} and len({r["target"] for r in mine}) == 1
        target, whole = mine[0]["target"], int(mine[0]["target"] // sum(sizes))
        assert {r["copies"] - whole for r in mine} <= {0, 1} and all(r["taken"] == r["copies"] * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target) <= max(sizes) / 2 + 1e-9
    by = Counter((r["doc_id"], r["text"], r["source"], r["copies"]) for r in got)
    again = mixing.mix_sources(spark.createDataFrame(table[::-1], "doc_id long, text string, source string").repartition(5), max_epochs=2.5).collect()
    assert by == Counter((r["doc_id"], r["text"], r["source"], r["copies"]) for r in again)


def test_mix_moves_no_text(spark, docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_water_level(spark):
    table = spark.createDataFrame([(30.0, 5), (300.0, 2), (3.0, 1), (900.0, 0)], "cap double, weight int")
    level = mixing.water_level(table, 200.0)
    assert level == pytest.approx((200 - 33) / 2) and mixing.water_level(table.where("weight > 5"), 10.0) == 0


# fingerprints


def brute_print(words, samples):
    """Consistent weighted samples of a bag of words, in plain Python."""
    bits, out, n = (1 << 21) - 1, [-1] * samples, Counter(words)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    h64 = lambda data, seed: xxhash.xxh64_intdigest(data, seed=seed)
    of_long = lambda x, seed: h64((x & (1 << 64) - 1).to_bytes(8, "little"), seed)
    best = [None] * samples
    for word, count in n.items():
        length = min(len(word), 63)
        term = signed(h64(word.encode(), 42) & ~63 & (1 << 64) - 1 | length)
        for k in range(samples):
            one, two = (h64((2 * k + i).to_bytes(4, "little"), of_long(term, 42)) for i in (0, 1))
            u = lambda h, at: ((h >> at & bits) + 0.5) / (1 << 21)
            r, c, beta = -math.log(u(one, 0) * u(one, 21)), -math.log(u(two, 0) * u(two, 21)), u(two, 42)
            t = math.floor(math.log(count * length * length) / r + beta)
            value = (math.log(c) - r * (t - beta + 1), of_long(t, of_long(term, 42)) & 0xFFFFFFFF)
            if best[k] is None or value < best[k]:
                best[k], out[k] = value, value[1]
    return out


def test_prints_agree_with_brute_force(spark):
    rng = random.Random(1)
    pairs = [(i, " ".join(rng.choices("the of erin thation ño", k=rng.randrange(12))), " ".join(rng.choices("the thing of ble", k=rng.randrange(9)))) for i in range(12)]
    parts = spark.createDataFrame([(i, "", a, b) for i, a, b in pairs], "i int, common string, rest string, other_rest string")
    got = {r["i"]: r for r in fingerprints.fingerprint_pairs(parts, ["i"], samples=8).collect()}
    for i, a, b in pairs:
        same = sum(x == y for x, y in zip(got[i]["print"] + got[i]["other_print"], brute_print(a.split(), 8) + brute_print(b.split(), 8), strict=True))
        assert same >= 15  # a logarithm may differ in its last bit


def test_likeness_estimates_jaccard(spark):
    a, b = "ab " * 30 + "cdefg " * 6 + "hij", "ab " * 10 + "cdefg " * 9 + "klmn op"
    parts = spark.createDataFrame([(0, "", a, b)], "i int, common string, rest string, other_rest string")
    got = fingerprints.fingerprint_pairs(parts, ["i"], samples=400).select(fingerprints.likeness(F.col("print"), F.col("other_print"))).first()[0]
    w = lambda t: {x: n * len(x) ** 2 for x, n in Counter(t.split()).items()}
    x, y = w(a), w(b)
    true = sum(min(x.get(t, 0), y.get(t, 0)) for t in {*x, *y}) / sum(max(x.get(t, 0), y.get(t, 0)) for t in {*x, *y})
    assert abs(got - true) < 4 * math.sqrt(true * (1 - true) / 400)


def test_edited_texts(docs):
    found = texts_of(docs)
    ids = sorted(found)
    got = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    prints = {}
    for i, doc_id in enumerate(ids):
        text, following = found[doc_id], found[ids[(i + 1) % len(ids)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = got[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"] and len(r["fingerprint"]) == 256
    for i, doc_id in enumerate(ids):
        a, b = got[doc_id]["fingerprint"], got[ids[(i + 1) % len(ids)]]["fingerprint"]
        assert got[doc_id]["near_next"] == sum(a[k : k + 8] == b[k : k + 8] for k in range(0, 256, 8)) / 32
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.5 > 0.1 > np.mean([r["near_next"] for r in got.values()])


@pytest.mark.parametrize("runs", [4, 1024])
@pytest.mark.parametrize("kind", ["outlier", "string", "date", "repeated"])
def test_next_rows_of_any_ids(spark, monkeypatch, kind, runs):
    monkeypatch.setattr(fingerprints, "LEAST_RUNS", runs)
    rng = random.Random(17)
    ids = {"outlier": [*range(40), 2**62, -(2**63)], "string": [f"d{rng.randrange(10**6)}\"," for _ in range(40)], "date": [datetime.date(2020, 1, 1) + datetime.timedelta(i) for i in range(40)], "repeated": [7] * 60 + [None] * 5}[kind]
    table = [(i, f"text {n}") for n, i in enumerate(ids)]
    rng.shuffle(table)
    df = spark.createDataFrame(table, f"doc_id {'string' if kind == 'string' else 'date' if kind == 'date' else 'long'}, text string").repartition(3)
    got = fingerprints.with_next(df).collect()
    assert len(got) == len(table) and len({r["pos"] for r in got}) == len(table)
    # one ring through all rows, in which ids ascend but for one place
    following = {r["text"]: r["next_text"] for r in got}
    ring, text = [], table[0][1]
    for _ in table:
        ring.append(text)
        text = following[text]
    id_of = {t: (i is not None, i) for i, t in table}
    assert text == table[0][1] and len(set(ring)) == len(table)
    falls = sum(id_of[a] > id_of[b] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
    assert falls == (0 if len(set(ids)) == 1 else 1)
    if runs > 4:
        assert len({r["run"] for r in got}) > len(table) / 2  # no run holds many, wherever the ids lie


def test_ids_without_an_order_are_refused(spark):
    with pytest.raises(TypeError, match="ids must be"):
        fingerprints.with_next(spark.sql("SELECT map(1, 2) AS doc_id, 'x' AS text"))


@pytest.mark.parametrize(("shared", "samples"), [(0.3, 32), (0.5, 32), (0.8, 32)])
def test_error_of_a_print(spark, shared, samples):
    """The root mean square error of a likeness is near sqrt(J (1 - J) / samples)."""
    rng = random.Random(18)
    table, true = [], []
    for i in range(150):
        words = [f"{rng.randrange(10**9):09d}" for _ in range(60)]
        n = round(60 * shared)
        a, b = words[: 30 + n // 2], words[30 - n // 2 :]
        table.append((i, "", " ".join(a), " ".join(b)))
        true.append(len({*a} & {*b}) / len({*a} | {*b}))
    parts = spark.createDataFrame(table, "i int, common string, rest string, other_rest string")
    got = fingerprints.fingerprint_pairs(parts, ["i"], samples=samples).select("i", fingerprints.likeness(F.col("print"), F.col("other_print")).alias("l")).collect()
    errors = np.array([r["l"] - true[r["i"]] for r in got])
    expected = math.sqrt(true[0] * (1 - true[0]) / samples)
    assert 0.8 * expected < math.sqrt((errors**2).mean()) < 1.25 * expected and abs(errors.mean()) < 3 * expected / math.sqrt(150)


def test_fingerprints_of_messy_rows(spark, messy, empty):
    got = fingerprints.edited_fingerprints(messy).collect()
    assert len(got) == len(MESSY) and len({r["fingerprint"] for r in got if r["n_chars"] == 11}) == 1
    assert fingerprints.edited_fingerprints(empty).count() == 0
    one = fingerprints.edited_fingerprints(messy.where("doc_id = 2")).first()
    assert one["near_next"] == 1.0


# sharding


def test_matrix_is_exact():
    rng = random.Random(4)
    for counts in ([5, 0, 31, 2], [], [1], [100, 100, 100]):
        matrix = sharding.communication_matrix(counts, 16, 3)
        assert [sum(r) for r in matrix] == counts
        sizes = [sum(r[s] for r in matrix) for s in range(16)]
        assert not counts or max(sizes) - min(sizes) <= 1
    draws = Counter(sharding.hypergeometric(rng, 6, 9, 5) for _ in range(20_000))
    for k in range(6):
        p = math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)
        assert abs(draws[k] / 20_000 - p) < 5 * math.sqrt(p * (1 - p) / 20_000) + 1e-9
    assert abs(sharding.hypergeometric(rng, 10**11, 9 * 10**11, 10**6) - 10**5) < 3000


@pytest.mark.parametrize("parts", [1, 7])
def test_shards_are_exact_and_slots_gapless(docs, parts):
    slim = docs.select("doc_id", F.length("text").alias("n")).repartition(parts, "doc_id")
    got = sharding.uniform_shards(slim, 16).toPandas()
    sizes = got.groupby("shard")["slot"].agg(["count", "min", "max", "nunique"])
    assert set(got["doc_id"]) == set(range(200)) and sizes["count"].max() - sizes["count"].min() <= 1
    assert (sizes["min"] == 0).all() and (sizes["max"] + 1 == sizes["count"]).all() and (sizes["nunique"] == sizes["count"]).all()


def test_shards_of_messy_rows(messy, empty):
    got = sharding.uniform_shards(messy, 4)
    assert got.count() == len(MESSY) and set(messy.columns) <= set(got.columns)
    assert sharding.uniform_shards(empty, 4).count() == 0
    twice = messy.unionAll(messy).unionAll(messy)
    assert sorted(r["count"] for r in sharding.uniform_shards(twice, 3).groupBy("shard").count().collect()) == [11, 11, 11]


def test_copies_of_a_row_are_spread(spark):
    """Of three copies of a row all stand in one of 16 shards with probability 1 / 256, two neighbours agree with 2 / rows."""
    three = spark.range(2000).select(F.explode(F.sequence(F.lit(1), F.lit(3))), "id").select("id").repartition(3)
    got = sharding.uniform_shards(three, 16).toPandas().sort_values(["shard", "slot"])
    together = (got.groupby("id")["shard"].nunique() == 1).mean()
    beside = (got["id"].diff() == 0).sum()
    assert together < 0.012 and beside < 20
    again = sharding.uniform_shards(three, 16).toPandas().sort_values(["shard", "slot"])
    assert again["id"].tolist() == got["id"].tolist()


def test_shuffle_is_uniform(spark):
    """Where a row of a small table goes, over many seeds: every place is as likely."""
    table, runs = spark.range(12).repartition(3, "id"), 60
    seen = Counter()
    for seed in range(runs):
        for r in sharding.uniform_shards(table, 3, seed=seed).collect():
            seen[r["id"], r["shard"]] += 1
    chi = sum((seen[i, s] - runs / 3) ** 2 / (runs / 3) for i in range(12) for s in range(3))
    assert chi < 60  # 24 degrees of freedom or fewer


def test_op3_by_brute_force(spark):
    got = queries.op3_uniform_shards(spark, SF).toPandas()
    assert list(got.columns) == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = texts_of(spark.read.parquet(f"{SF}/documents.parquet"))
    for doc_id, size, crc in zip(got["doc_id"], got["size"], got["text_crc32"], strict=True):
        text = (found[doc_id] or "").encode()
        assert (size, crc) == (len(text) + 1, zlib.crc32(text))
    counts = got.groupby("shard")["slot"].agg(["count", "max"])
    assert len(counts) == 16 and counts["count"].max() - counts["count"].min() <= 1 and (counts["max"] == counts["count"] - 1).all()
    assert set(got["law"]) == {"rows"} and got["grown_shard"].isna().all() and sorted(got["doc_id"]) == sorted(found)


def test_op3_deals_whole_documents(spark, monkeypatch):
    deal = sharding.uniform_shards

    def changed(df, shards):
        assert {"doc_id", "text", "lang", "source", "n_chars"} <= set(df.columns)
        return deal(df, shards).withColumn("text", F.upper("text"))

    monkeypatch.setattr(sharding, "uniform_shards", changed)
    found = texts_of(spark.read.parquet(f"{SF}/documents.parquet"))
    for r in queries.op3_uniform_shards(spark, SF).collect():
        text = (found[r["doc_id"]] or "").upper().encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))


# media


def test_streams_hold_their_payload():
    rng = random.Random(2)
    for n in [0, 1, 63, 64, 65, 2048, 2049, 5000, 70_000]:
        payload = media.padded(rng.randbytes(n))
        stream = media.mux(payload)
        found = media.demux(stream)
        assert found["payload"] == payload and len(payload) % 64 == 0 and len(payload) > 0 and found["breaks"] == 0
        assert found["pts"] == [k * 2048 * 90_000 // 8000 for k in range(found["units"])]
        assert [t for _, t in found["random_access"]] == found["pts"][::16]
        for packet, _ in found["random_access"]:
            assert stream[188 * packet] == 0x47 and stream[188 * packet + 5] & 0x40


def test_broken_streams():
    stream = media.mux(media.padded(bytes(range(256)) * 40))
    lost = stream[: 188 * 4] + stream[188 * 5 :]
    assert media.demux(lost)["breaks"] == 1
    doubled = stream[: 188 * 4] + stream[188 * 3 : 188 * 4] + stream[188 * 4 :]
    assert media.demux(doubled)["payload"] == media.demux(stream)["payload"]
    for bad in (stream[:-1], b"\0" + stream[1:], stream[376:], b""):
        with pytest.raises(media.StreamError):
            media.demux(bad)
    assert media.section_crc(b"123456789") == 0x0376E6E7
    # a packet that stands still but differs is not one sent twice, nor is a third one
    other = bytearray(stream[188 * 3 : 188 * 4])
    other[100] ^= 1
    assert media.demux(stream[: 188 * 4] + bytes(other) + stream[188 * 4 :])["breaks"] > 0
    assert media.demux(stream[: 188 * 4] + 2 * stream[188 * 3 : 188 * 4] + stream[188 * 4 :])["breaks"] > 0


def test_lost_packets_are_seen():
    """Wherever 1 to 40 packets are cut, the payload is whole, or there are breaks, or the stream is refused."""
    rng = random.Random(16)
    payload = media.padded(rng.randbytes(102_400))
    stream, seen = media.mux(payload), 0
    n = len(stream) // 188
    cuts = [(at, k) for k in (1, 2, 11, 12, 15, 16, 17, 24, 32, 33, 40) for at in range(0, n - k + 1, 5)] + [(n - k, k) for k in range(1, 41)] + [(2, n - 2)]
    for at, k in cuts:
        try:
            found = media.demux(stream[: 188 * at] + stream[188 * (at + k) :])
        except media.StreamError:
            continue
        assert found["breaks"] > 0, (at, k)
        seen += 1
    assert seen > 0.8 * len(cuts)


def test_discontinuity_may_be_told():
    stream = bytearray(media.mux(media.padded(bytes(5000))))
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    at = next(i for i in range(4, len(packets)) if packets[i][3] & 0x20 and packets[i][4])
    for i in range(at, len(packets)):
        packets[i][3] = packets[i][3] & 0xF0 | (packets[i][3] + 5) & 15
    assert media.demux(b"".join(packets))["breaks"] == 1
    packets[at][5] |= 0x80
    assert media.demux(b"".join(packets))["breaks"] == 0


def test_sections_across_packets():
    """A program map of two packets is read, with the tables' packets sent twice."""
    payload = media.padded(bytes(range(256)))
    stream = media.mux(payload)
    pad = bytes([0x80, 200]) + bytes(200)
    body = bytes([0xE1, 0, 0xF0, len(pad)]) + pad + bytes([6, 0xE1, 0, 0xF0, 0])
    section = b"\0" + media._section(2, 1, body)
    one = bytes([0x47, 0x50, 0, 0x10]) + section[:184]
    two = (bytes([0x47, 0x10, 0, 0x11]) + section[184:]).ljust(188, b"\xff")
    found = media.demux(stream[:188] * 2 + one + one + two + stream[376:])
    assert found["payload"] == payload and found["breaks"] == 0
    with pytest.raises(media.StreamError):
        media.demux(stream[:188] + two + one + stream[376:])


def test_media_of_messy_rows(messy, empty):
    got = media.from_media(media.to_media(messy)).collect()
    assert len(got) == len(MESSY)
    for r in got:
        text = next(t for d, t, *_ in MESSY if d == r["doc_id"] and len((t or "").encode()) == r["n_bytes"]) or ""
        payload = media.padded(text.encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert media.from_media(media.to_media(empty)).count() == 0


# tokens


def test_possessive_runs_find_the_same_words():
    """The pattern as published, by classes of characters, over texts of few kinds of them."""
    blank, letters, numbers = tokenization.BLANK, tokenization.LETTERS, tokenization.NUMBERS
    published = re.compile(rf"{tokenization.CONTRACTIONS}| ?[{letters}]+| ?[{numbers}]+| ?[^{blank}{letters}{numbers}]+|[{blank}]+(?![^{blank}])|[{blank}]+")
    rng = random.Random(13)
    for _ in range(3000):
        text = "".join(rng.choices("asteré1² \n'.,", k=rng.randrange(30)))
        assert tokenization.SPACED.findall(text) == published.findall(text)


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_ids_are_the_library_s(docs, path):
    rng = random.Random(5)
    alphabet = "ab 'srtvelmSRTVELMÉß\n\t1²½! \x1c\x85\xa0éèK日ſŉİ́#.,"
    texts = [*texts_of(docs).values(), *("".join(rng.choices(alphabet, k=rng.randrange(30))) for _ in range(1500)), "<|endoftext|> x", "", LONG]
    encoder, library = tokenization.WordEncoder(path), Tokenizer.from_file(path)
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encoder.encode(text) == np.asarray(want.ids, dtype="<u4").tobytes(), text[:80]


def test_counts_are_the_library_s(docs):
    rng = random.Random(6)
    texts = [*texts_of(docs).values(), *("".join(rng.choices("ab 'srtvelm\n\t1!é日 　", k=rng.randrange(25))) for _ in range(1500)), "x<|endoftext|> y  <|endoftext|>", "", LONG[:50_000]]
    machine, library = token_counts.Transducer(BYTES), Tokenizer.from_file(BYTES)
    for i, (text, want) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True)):
        assert machine.count(text) == len(want.ids), text[:80]
        if i % 9 == 0:
            assert machine.count(text[:2000], chunk=7) == machine.count(text[:2000])


def test_chunk_maps_compose_in_any_grouping():
    machine = token_counts.Transducer(BYTES)
    text = "The thing's 12  x\n\n y 'll go!! on and on, erin thation"
    maps = [machine.chunk_map(text[i : i + 5], i == 0) for i in range(0, len(text), 5)]
    left = maps[0]
    for m in maps[1:]:
        left = machine.compose(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = machine.compose(m, right)
    assert left[1] == right[1] == machine.count(text)


def test_resets_begin_words():
    """The library cuts texts where a reset says, and no state before it matters."""
    machine, rng = token_counts.Transducer(BYTES), random.Random(20)
    for kind, chars in (("L", token_counts._LETTER), ("N", token_counts._DIGIT), ("P", token_counts._SIGN)):
        inside = re.compile(f"[{chars}]")
        assert all(machine.kind(chr(c)) == kind for c in range(0x110000) if inside.match(chr(c)) and (c < 0x3100 or c % 97 == 0))
    for _ in range(400):
        text = "".join(rng.choices("ab'srtvelm1日本。、!? \n", k=40))
        n = len(machine.reduced([machine.chunk_map(text, True)])) and machine.count(text)
        cut = rng.randrange(1, 39)
        two = machine.compose(machine.chunk_map(text[:cut], True), machine.chunk_map(text[cut:]))
        assert two[1] == n
    assert len(machine.chunk_map("日本語。" * 100)[0]) < 8


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "SPLIT", 300)
    monkeypatch.setattr(token_counts, "PIECE", 70)
    rng, library = random.Random(21), Tokenizer.from_file(BYTES)
    table = [(i, "".join(rng.choices("ab 'srtvelm\n1!é日。😀", k=rng.choice([0, 20, 299, 301, 1000])))) for i in range(40)]
    table += [(7, "x" * 2000), (7, "x" * 2000), (None, "日" * 900), (50, "a b " * 200 + "<|endoftext|>"), (51, None)]
    got = token_counts.count_tokens(spark.createDataFrame(table, "doc_id long, text string").repartition(3), BYTES).collect()
    want = Counter((d, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in table)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want


def test_forgetting_states_changes_nothing(monkeypatch, docs):
    monkeypatch.setattr(token_counts, "STATES", 50)
    machine, library = token_counts.Transducer(BYTES), Tokenizer.from_file(BYTES)
    text = texts_of(docs)[0]
    assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts_of_messy_rows(messy, empty):
    library = Tokenizer.from_file(BYTES)
    got = token_counts.count_tokens(messy, BYTES).collect()
    want = sorted((str(d), len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, *_ in MESSY)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got) == want
    assert token_counts.count_tokens(empty, BYTES).count() == 0


def test_token_store(spark, docs, messy, empty, tmp_path):
    library = Tokenizer.from_file(BYTES)
    for table in (docs.select("doc_id", "text"), messy, empty):
        got = token_store.stored_places(table, BYTES).collect()
        assert len(got) == table.count()
        got.sort(key=lambda r: r["start"])
        ids = [r["doc_id"] for r in got]
        assert ids == sorted(ids, key=lambda x: (x is not None, x))
        assert [r["start"] for r in got] == list(itertools.accumulate([r["n_tokens"] for r in got], initial=0))[:-1]
        crc = lambda t: zlib.crc32(np.asarray([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes())
        assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == sorted((str(r["doc_id"]), crc(r["text"])) for r in table.collect())
    token_store.write_tokens(docs, str(tmp_path / "orc"), BYTES)
    assert [r["doc_id"] for r in token_store.read_tokens(spark, str(tmp_path / "orc"), [7, 9]).orderBy("doc_id").collect()] == [7, 9]


def rows_scanned(df):
    """How many rows the scan of files gave on, after ``df`` was collected."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_token_store_skips_by_index_and_bloom_filter(spark, tmp_path):
    """Even ids only: an id beyond all is skipped by its range, an odd one between them by the Bloom filters."""
    table = spark.range(0, 40_000, 2).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    token_store.write_tokens(table, str(tmp_path / "orc"), BYTES)
    n = table.count()
    read = lambda ids: token_store.read_tokens(spark, str(tmp_path / "orc"), ids)
    assert rows_scanned(read([50_000])) == 0
    assert rows_scanned(read([7_778])) <= 2 * token_store.GROUP_ROWS < n
    hits = sum(rows_scanned(read([i])) > 0 for i in range(1, 2001, 100))
    assert hits <= 2  # of 20, each with a chance of 0.01
    for file in (tmp_path / "orc").glob("*.orc"):
        assert orc.ORCFile(file).row_index_stride == token_store.GROUP_ROWS


# packing


def test_best_fit_by_brute_force():
    rng = random.Random(7)
    for _ in range(200):
        sizes, limit = np.array([rng.randrange(1, 21) for _ in range(rng.randrange(1, 40))]), 20
        got, rooms = packing.best_fit(sizes, limit), []
        for size in sorted(sizes.tolist(), reverse=True):
            fits = [i for i, r in enumerate(rooms) if r >= size]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= size
            else:
                rooms.append(limit - size)
        assert np.bincount(got, sizes).max() <= limit and got.max() + 1 == len(rooms)
        offsets = packing._offsets(got, sizes)
        for b in set(got.tolist()):
            mine = sorted(zip(offsets[got == b].tolist(), sizes[got == b].tolist(), strict=True))
            assert [o for o, _ in mine] == list(itertools.accumulate([s for _, s in mine], initial=0))[:-1]


def packed_right(got, table, limit):
    library = Tokenizer.from_file(WORDS)
    per = Counter((r["doc_id"], r["text"]) for r in table.collect())
    want = Counter()
    for (doc_id, text), n in per.items():
        ids = np.asarray([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, at in enumerate(range(0, len(ids), limit)):
            want[doc_id, piece, at, len(ids[at : at + limit]), zlib.crc32(ids[at : at + limit].tobytes())] += n
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for mine in bins.values():
        mine.sort()
        assert [o for o, _ in mine] == list(itertools.accumulate([n for _, n in mine], initial=0))[:-1]
        assert sum(n for _, n in mine) <= limit
    return len(bins), sum(r["length"] for r in got)


def test_sequences_are_whole_and_few(docs, messy, empty, monkeypatch):
    got = packing.pack_documents(docs, WORDS).collect()
    bins, total = packed_right(got, docs, 2048)
    assert bins <= math.ceil(total / 2048) * 1.02 + 1
    packed_right(packing.pack_documents(messy, WORDS, limit=64).collect(), messy, 64)
    assert packing.pack_documents(empty, WORDS).count() == 0
    monkeypatch.setattr(packing, "TOGETHER", 40)  # many small rounds
    many, _ = packed_right(packing.pack_documents(docs.repartition(9), WORDS).collect(), docs, 2048)
    assert many <= bins * 1.15 + 1


def sequences_of(rows):
    """The ids of each sequence, put together from the rows' places."""
    out = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        ids = out.setdefault(r["sequence_id"], bytearray())
        assert len(ids) == 4 * r["offset"] and len(r["ids"]) == 4 * r["length"]
        ids += r["ids"]
    return out


def test_placed_ids_make_sequences_and_documents(docs, messy):
    library = Tokenizer.from_file(WORDS)
    for table, limit in ((docs, 2048), (messy, 64)):
        got = packing.pack_documents(table, WORDS, limit=limit, with_ids=True).collect()
        packed_right(got, table, limit)
        sequences = sequences_of(got)
        assert all(len(ids) <= 4 * limit for ids in sequences.values()) and all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in got)
        if table is docs:
            for doc_id, text in texts_of(docs).items():
                pieces = sorted((r["piece"], r["sequence_id"], r["offset"], r["length"]) for r in got if r["doc_id"] == doc_id)
                ids = b"".join(bytes(sequences[s][4 * o : 4 * (o + n)]) for _, s, o, n in pieces)
                assert ids == np.asarray([*library.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()


def test_op5_digests_placed_ids(spark, monkeypatch):
    pack, seen = packing.pack_documents, []

    def changed(docs, tokenizer, **options):
        seen.append(options.get("with_ids"))
        return pack(docs, tokenizer, **options).withColumn("ids", F.encode(F.lit("placed"), "utf-8"))

    monkeypatch.setattr(packing, "pack_documents", changed)
    got = queries.op5_pack_sequences(spark, SF)
    assert seen == [True] and got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert {r["ids_crc32"] for r in got.collect()} == {zlib.crc32(b"placed")}


# line dedup


def brute_lines(table, least):
    """Lines that lie in a run of ``least`` words that stood earlier, by looking at every run."""
    docs = sorted({(r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in table if r["text"] is not None}, key=lambda r: r[:2])
    seen, gone = set(), {}
    for has_id, doc_id, text in docs:
        lines = [(i, x) for i, x in enumerate(text.split("\n")) if x.split()]
        for s in range(len(lines)):
            total = 0
            for e in range(s, len(lines)):
                total += len(lines[e][1].split())
                if total >= least:
                    run = tuple(x for _, x in lines[s : e + 1])
                    if run in seen:
                        gone.setdefault((has_id, doc_id, text), set()).update(range(lines[s][0], lines[e][0] + 1))
                    seen.add(run)
    return {k: "\n".join(x for i, x in enumerate(k[2].split("\n")) if i not in gone.get(k, ())) for k in docs}


def test_repeated_lines_by_brute_force(spark):
    rng = random.Random(8)
    pool = [" ".join(rng.choices("abcdefgh", k=rng.randrange(0, 7))) for _ in range(14)]
    table = [(i, "\n".join(rng.choices(pool, k=rng.randrange(0, 12)))) for i in range(60)] + [(None, "\n".join(pool)), (61, None), (62, "")]
    want = brute_lines([{"doc_id": d, "text": t} for d, t in table], 9)
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(table, "doc_id long, text string"), min_words=9).collect()
    assert len(got) == len(table)
    source = {d: t for d, t in table}
    for r in got:
        text = source[r["doc_id"]]
        assert r["text"] == (None if text is None else want[r["doc_id"] is not None, r["doc_id"] or 0, text])
    assert sum(r["n_removed"] for r in got) > 50


def test_line_dedup_of_messy_rows(messy, empty):
    got = line_dedup.drop_repeated_lines(messy)
    assert got.count() == len(MESSY) and set(messy.columns) <= set(got.columns)
    assert got.where("text is null").count() == 2 and got.where("doc_id = 1 and n_removed = 0").count() == 2
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_planted_passages_go_and_clean_documents_stay(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("aeinorst", k=rng.randrange(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n))
    passage = sentence(30) + "\n" + sentence(25)
    clean = [(i, "\n".join(sentence(20) for _ in range(5))) for i in range(30)]
    planted = [(i, f"{sentence(12)}\n{passage}\n{sentence(9)}") for i in range(30, 45)]
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(spark.createDataFrame(clean + planted, "doc_id long, text string")).collect()}
    assert all(got[i]["text"] == t for i, t in [*clean, planted[0]])
    assert all(passage not in got[i]["text"] and got[i]["n_removed"] == 2 for i, _ in planted[1:])


@pytest.mark.parametrize("extend", [False, True])
def test_long_texts_of_many_lines(spark, extend):
    """Two texts of 30,000 lines that share 20,000 of them, and repeat lines of their own: time grows with the lines."""
    rng = random.Random(25)
    line = lambda: " ".join(f"{rng.randrange(10**12)}" for _ in range(rng.randrange(1, 9)))
    shared = [line() for _ in range(20_000)]
    one, two = shared + [line() for _ in range(10_000)], [line() for _ in range(9_000)] + shared + ["same line"] * 1000
    table = spark.createDataFrame([(1, "\n".join(one)), (2, "\n".join(two))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(table, extend=extend).collect()}
    assert got[1]["text"] == "\n".join(one) and got[2]["n_lines"] == 30_000
    kept = got[2]["text"].split("\n")
    assert kept[:9000] == two[:9000] and not {*kept} & {*shared}
    assert kept[9000:] == ["same line"]  # the run from its second line on stood one line earlier


def brute_passages(table, least):
    """Lines that ``brute_lines`` finds, or that lie whole in a passage of ``least`` words around a shared line, by looking at every passage."""
    docs, seen, gone = sorted(((d, t) for d, t in table if t is not None), key=lambda r: (r[0] is not None, r[0] or 0)), set(), {}
    kept = brute_lines([{"doc_id": d, "text": t} for d, t in docs], least)
    for doc_id, text in docs:
        lines, words = [(i, x) for i, x in enumerate(text.split("\n")) if x.split()], text.split()
        at = list(itertools.accumulate([len(x.split()) for _, x in lines], initial=0))
        for n, (_, line) in enumerate(lines):
            new = set()
            for s in range(max(0, at[n + 1] - least), min(at[n], len(words) - least) + 1):
                key = (line, at[n] - s, tuple(words[s : s + least]))
                if key in seen:
                    whole = [lines[m][0] for m in range(len(lines)) if at[m] >= s and at[m + 1] <= s + least]
                    gone.setdefault(doc_id, set()).update(range(whole[0], whole[-1] + 1))
                new.add(key)
            seen |= new
    out = {}
    for (has_id, doc_id, text), left in kept.items():
        # what stays of lines alone, then without the lines of passages
        lines, rest = text.split("\n"), iter(left.split("\n"))
        line, stays = next(rest, None), []
        for i, x in enumerate(lines):
            if x == line:
                stays += [] if i in gone.get(doc_id if has_id else None, ()) else [x]
                line = next(rest, None)
        out[doc_id if has_id else None] = "\n".join(stays)
    return out


def test_extended_runs_by_brute_force(spark):
    rng = random.Random(18)
    pool = [[" ".join(rng.choices("abcdefgh", k=rng.randrange(1, 7))) for _ in range(9)] for _ in range(6)]
    # whole runs of a pool's lines, whose first and last lines go on in other ways
    table = []
    for i in range(80):
        run = rng.choice(pool)
        a = rng.randrange(6)
        lines = run[a : a + rng.randrange(2, 4)]
        lines[0], lines[-1] = f"x{i} {lines[0]}" if rng.random() < 0.7 else lines[0], f"{lines[-1]} y{i}" if rng.random() < 0.7 else lines[-1]
        table.append((i, "\n".join([f"s{i}", *lines, f"t{i}"])))
    table += [(None, "\n".join(pool[0])), (81, None), (82, "")]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    want = brute_passages(table, 9)
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(frame, min_words=9, extend=True).collect()}
    plain = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(frame, min_words=9).collect()}
    assert len(got) == len(table)
    assert all(got[d]["text"] == (None if t is None else want[d]) for d, t in table)
    assert all(got[d]["n_removed"] >= plain[d]["n_removed"] for d, _ in table)
    assert sum(r["n_removed"] for r in got.values()) > sum(r["n_removed"] for r in plain.values()) + 10


def test_passages_that_begin_and_end_inside_lines(spark):
    word = iter(f"w{i}" for i in range(100_000))
    fresh = lambda n: " ".join(next(word) for _ in range(n))
    head, line, tail = fresh(20), fresh(14), fresh(20)
    table = [(i, f"{fresh(9)}\n{fresh(7)} {head}\n{line}\n{tail} {fresh(6)}\n{fresh(9)}") for i in range(4)]
    short = [(i, f"{fresh(7)} {head}\n{line}\n{fresh(30)}") for i in range(4, 6)]  # 34 shared words
    frame = spark.createDataFrame(table + short, "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.drop_repeated_lines(frame, extend=True).collect()}
    assert [got[i]["n_removed"] for i in range(6)] == [0, 1, 1, 1, 0, 0] and all(line not in got[i]["text"] for i in (1, 2, 3))


def test_extended_runs_of_messy_rows(messy, empty):
    got = line_dedup.drop_repeated_lines(messy, extend=True)
    assert got.count() == len(MESSY) and got.where("text is null").count() == 2 and got.agg(F.sum("n_removed")).first()[0] == 0
    assert line_dedup.drop_repeated_lines(empty, extend=True).count() == 0


# quality


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op9_quality(spark, sf).join(labels, "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got["doc_id"]]).all()
    held = got[got["held_out"]]
    good, bad = held[held["quality"] == 1]["score"], held[held["quality"] == 0]["score"]
    assert np.mean([g > b for g in good for b in bad]) > 0.97 and (held["predicted"] == held["quality"]).mean() > 0.9
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()


def test_held_out_labels_are_not_read(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    scores = lambda t: [r["score"] for r in quality.classify(docs, t).orderBy("doc_id").collect()]
    assert scores(labels) == scores(turned)


def test_quality_of_messy_rows(spark, messy, empty):
    none = spark.createDataFrame([(None, 1), (2, None)], "doc_id long, quality int")
    got = quality.classify(messy, none)
    assert got.count() == len(MESSY) and {r["score"] for r in got.collect()} == {0.5}
    some = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (6, 1), (8, 1), (4, 0)], "doc_id long, quality int")
    assert quality.classify(messy, some).where("score between 0 and 1").count() == len(MESSY)
    assert quality.classify(empty, some).count() == 0


def test_fit_by_plain_ridge(spark):
    """The fitted weights are those of one ridge regression over all labelled rows that aren't held out."""
    rng = random.Random(22)
    table = [(i, " ".join(rng.choice(["lorem,", "Ipsum", "x9#", "dolor.", "!!"]) for _ in range(rng.randrange(1, 60)))) for i in range(300)]
    labels = [(i, rng.randrange(2)) for i in range(0, 300, 2)]
    model = quality.fit(spark.createDataFrame(table, "doc_id long, text string").repartition(5), spark.createDataFrame(labels, "doc_id long, quality int"))
    seen = [(quality.statistics(dict(table)[i]), y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    x, y = np.array([s for s, _ in seen]), np.array([float(v) for _, v in seen])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.where(x.std(0) > 1e-9, x.std(0), 1.0))
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    features = np.c_[np.ones(len(z)), np.cos(z @ model.directions + model.phases) * math.sqrt(2 / quality.FEATURES)]
    penalty = quality.PENALTY * len(z) / quality.FEATURES * np.diag([1e-9, *[1.0] * quality.FEATURES])
    want = np.linalg.solve(features.T @ features + penalty, features.T @ y)
    assert np.allclose(features @ want, features @ model.weights, atol=1e-6)
    # products of features approximate a Gaussian kernel
    wide = np.random.default_rng(1)
    directions, phases = wide.standard_normal((x.shape[1], 20_000)) / (quality.WIDTH * math.sqrt(x.shape[1]) * 2), wide.uniform(0, 2 * math.pi, 20_000)
    c = np.cos(z[:20] @ directions + phases) * math.sqrt(2 / 20_000)
    kernel = np.exp(-((z[:20, None] - z[None, :20]) ** 2).sum(-1) / (2 * (quality.WIDTH * math.sqrt(x.shape[1]) * 2) ** 2))
    assert np.abs(c @ c.T - kernel).max() < 0.06


def test_isotonic_by_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(30):
        v, w = rng.random(6), rng.integers(1, 4, 6).astype(float)
        got = quality.isotonic(v, w)
        assert (np.diff(got) >= -1e-12).all()
        best = min((sum(w * (v - f) ** 2) for f in (np.sort(rng.random(6)) for _ in range(300))), default=9)
        assert sum(w * (v - got) ** 2) <= best + 1e-9


# near-duplicates


def brute_classes(table):
    texts = sorted({t if t is not None else "" for _, t in table})
    words = [near_dedup.words_of(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = words[i], words[j]
        if a == b or (abs(len(a) - len(b)) <= 0.1 * max(len(a), len(b)) and aligned(a, b)):
            root[find(j)] = find(i)
    where = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for d, t in table:
        c = where[t or ""]
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return [least.get(where[t or ""]) for _, t in table]


def distance(a, b):
    """The edit distance, by its whole table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def aligned(a, b):
    return 10 * distance(a, b) <= max(len(a), len(b))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n if words else 0):
        at = rng.randrange(max(1, len(words)))
        words[at : at + 1] = rng.choice(([], ["new"], [*words[at : at + 1], "more"]))
    return words


def test_alignment_agrees_with_table():
    rng, near = random.Random(10), 0
    for _ in range(400):
        a = rng.choices(range(30), k=rng.randrange(1, 90))
        b = edited(rng, a, rng.randrange(0, 12)) or [1]
        x, y = (near_dedup.hashed([str(v) for v in s]) for s in (a, b))
        assert near_dedup.similar(x, y) == aligned(a, b)
        near += 0 < distance(a, b) and aligned(a, b)
    assert near > 40


def test_columns_agree_with_table():
    rng = random.Random(23)
    for _ in range(300):
        a = rng.choices(range(12), k=rng.randrange(1, 80))
        b = edited(rng, a, rng.randrange(0, 30)) or [1]
        d = distance(a, b)
        assert near_dedup._distance_within(a, b, d) and not near_dedup._distance_within(a, b, d - 1)


def test_hashes_of_words(monkeypatch):
    rng = random.Random(24)
    texts = ["".join(rng.choices("ab é日 \t\n\x0b\x0c\r\x1c\x85\xa0", k=rng.randrange(60))) for _ in range(500)]
    seen = {}
    for text in texts:
        words, h = near_dedup.words_of(text), near_dedup.hashes_of(text.encode())
        assert len(words) == len(h) and text.encode().split() == [w.encode() for w in words]
        assert all(seen.setdefault(w, x) == x for w, x in zip(words, h.tolist(), strict=True))
    assert len(set(seen.values())) == len(seen) > 500
    whole = near_dedup.hashes_of(" ".join(texts).encode())
    monkeypatch.setattr(near_dedup, "BYTES", 50)
    assert (near_dedup.hashes_of(" ".join(texts).encode()) == whole).all()


def test_profiles_leave_out_no_near_copy():
    rng = random.Random(13)
    for _ in range(300):
        a = rng.choices(range(50), k=rng.randrange(1, 400))
        b = edited(rng, a, rng.randrange(0, 60)) or [1]
        x, y = (near_dedup.hashed([str(v) for v in s]) for s in (a, b))
        one, two = (near_dedup._profiles([near_dedup.profile(h)]) for h in (x, y))
        assert near_dedup._near(one, len(a), two, len(b))[0] or not near_dedup.similar(x, y)


@pytest.mark.parametrize(("changed", "least"), [(0.02, 0.99), (0.05, 0.99), (0.08, 0.97), (0.1, 0.93)])
def test_near_copies_share_a_key(changed, least):
    """Pairs of 300 words of which so many, at random places, were replaced: the share that meets in a bucket."""
    rng, met = random.Random(14), 0
    for i in range(150):
        a = [f"w{rng.randrange(5000)}" for _ in range(300)]
        b = list(a)
        for at in rng.sample(range(300), round(300 * changed)):
            b[at] = f"new{i}-{at}"
        x, y = near_dedup.hashed(a), near_dedup.hashed(b)
        assert near_dedup.similar(x, y)
        met += bool({*near_dedup.keys(near_dedup.kmers(x))} & {*near_dedup.keys(near_dedup.kmers(y))})
    assert met / 150 >= least


@pytest.mark.parametrize("crowd", [300, 1 << 20])
def test_unlike_texts_of_a_large_bucket_are_compared(spark, monkeypatch, crowd):
    """Texts that share a passage fill buckets; the near copies among them are linked, whoever the leaders are."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "CROWD", crowd)
    rng = random.Random(15)
    passage = [f"p{i}" for i in range(60)]
    table = []
    for i in range(120):
        own = [f"o{i}-{j}" for j in range(20)]
        table += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + edited(rng, own, 3)))]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert got == dict(zip([d for d, _ in table], brute_classes(table), strict=True))


def test_a_crowded_bucket_loses_no_near_copies(spark):
    """Copies with every fifth of their own words changed meet by the passage alone that all 1600 texts share."""
    passage, table = [f"p{i}" for i in range(60)], []
    for i in range(800):
        own = [f"o{i}-{j}" for j in range(55)]
        table += [(2 * i, " ".join(passage + own)), (2 * i + 1, " ".join(passage + [f"x{w}" if j % 5 == 2 else w for j, w in enumerate(own)]))]
    keys = [set(near_dedup.keys(near_dedup.kmers(near_dedup.hashes_of(t.encode())))) for _, t in table]
    met = [bool(keys[2 * i] & keys[2 * i + 1]) for i in range(800)]
    crowd = Counter(k for x in keys for k in x).most_common(1)[0][1]
    assert sum(met) > 780 and crowd > 1200
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string").repartition(4)).collect()}
    assert [got[2 * i + 1] == 2 * i for i in range(800)] == met
    assert all(got[2 * i] == 2 * i for i in range(800))


def test_classes_do_not_depend_on_the_size_of_a_block(spark, monkeypatch):
    """Texts of many lengths that share a passage: one bucket is compared as one block, or as many, with the same links."""
    rng = random.Random(12)
    passage, table = [f"p{i}" for i in range(60)], []
    for i in range(60):
        own = [f"o{i}-{j}" for j in range(rng.randrange(40, 80))]
        table += [" ".join(passage + edited(rng, own, n)) for n in (0, rng.randrange(1, 8), rng.randrange(8, 16))]
    nodes = [near_dedup.hashes_of(t.encode()) for t in table]
    keys = [set(near_dedup.keys(near_dedup.kmers(h))) for h in nodes]
    root = list(range(len(table)))
    for i, j in itertools.combinations(range(len(table)), 2):
        if keys[i] & keys[j] and near_dedup.similar(nodes[i], nodes[j]):
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
    docs = spark.createDataFrame(list(enumerate(table)), "doc_id long, text string").repartition(4)
    for block in (1 << 30, 16, 3):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
        assert [got[i] for i in range(len(table))] == root
    assert max(Counter(k for x in keys for k in x).values()) > 100 and 60 < len(set(root)) < 150


def test_near_duplicates_by_brute_force(spark):
    rng = random.Random(11)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 90))] for _ in range(25)]
    table = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i in range(25, 150):
        table.append((i, " ".join(edited(rng, rng.choice(base[:12]), rng.randrange(0, 4)))))
    table += [(150, ""), (151, None), (152, " \n"), (153, "w1"), (153, "w1"), (None, "w2 w3"), (None, "w2  w3")]
    hub = [f"h{i}" for i in range(150)]  # one large group whose members are often unlike each other
    table += [(200 + i, " ".join(edited(rng, hub, rng.randrange(0, 7)))) for i in range(60)]
    got = near_dedup.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).collect()
    want = Counter(zip([d for d, _ in table], brute_classes(table), strict=True))
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len({c for _, c in want})


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90), (90, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in near_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {100: 90}


def test_near_dedup_of_messy_rows(messy, empty):
    got = near_dedup.drop_near_duplicates(messy)
    assert set(got.columns) == set(messy.columns)
    assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "3", "6", "7", "8", "None"]
    assert near_dedup.near_duplicates(messy).count() == len(MESSY) and near_dedup.drop_near_duplicates(empty).count() == 0
