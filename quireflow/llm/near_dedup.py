"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, with_key, written

#: Words of a k-mer; share of the longer text's words that an alignment of two near copies leaves in place.
K, SIMILARITY = 5, 0.9
#: k-mers of a key by a text's least number of words, and keys of a text. Of two texts in which a tenth of the words
#: differs at random places 0.59 of the k-mers are common, 0.42 of all; they agree in a key of three with probability
#: 0.42 ** 3 and miss all 64 with 0.007. Short texts have fewer in common, and take fewer; the shortest take them all.
TAKEN, KEYS = {0: 1, 20: 2, 100: 3}, 64
#: Members of a block of a larger bucket; bins of a profile, and how many of them are added up for a first comparison.
BLOCK, BINS, FOLDED = 1024, 256, 8
#: Numbers of profiles that are compared at once.
CROWD = 1 << 20
#: Bytes of a text that are hashed at once; numbers in an array of hashes; pairs of texts held as strings at once.
BYTES, CELLS, PAIRS = 1 << 20, 1 << 20, 200

_WORDS, _BLANK = re.compile(WORD), re.compile(rb"[ \t-\r]")
_ODD = np.random.default_rng(3).integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = np.random.default_rng(4).integers(0, 1 << 32, KEYS, dtype=np.uint32)


def words_of(text: str) -> list[str]:
    return _WORDS.findall(text)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers, by 64 bits, of an odd number and of its inverse."""
    odd = 0x9E3779B97F4A7C15
    ways = (np.full(n, x, dtype=np.uint64) for x in (odd, pow(odd, -1, 1 << 64)))
    one, two = (np.r_[np.uint64(1), np.cumprod(x)[: n - 1]] for x in ways)
    return one, two


def hashes_of(data: bytes) -> np.ndarray:
    """A hash for each word of a text in UTF-8: sums of its bytes by powers, so that all words are hashed at once."""
    if len(data) > BYTES:  # at a blank, so that words stay whole
        parts, at = [], 0
        while at < len(data):
            cut = _BLANK.search(data, at + BYTES)
            end = cut.start() if cut else len(data)
            parts.append(_hashes(data[at:end]))
            at = end
        return np.concatenate(parts)
    return _hashes(data)


def _hashes(data: bytes) -> np.ndarray:
    a = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(a) + 2, dtype=np.int8)
    inside[1:-1] = (a > 32) | (a < 9) | ((a > 13) & (a < 32))
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    up, down = _powers(1 << max(12, (len(a) - 1).bit_length()))
    sums = np.zeros(len(a) + 1, dtype=np.uint64)
    np.cumsum((a + np.uint64(1)) * up[: len(a)], out=sums[1:])
    return _mixed(_mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))


def hashed(words: list[str]) -> np.ndarray:
    return hashes_of(" ".join(words).encode())


def kmers(h: np.ndarray) -> np.ndarray:
    """A hash for each run of ``K`` words, in order; for fewer words one of them all; none without words."""
    if not len(h):
        return h
    k = min(K, len(h))
    total = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total += _mixed(h[i : len(h) - k + 1 + i]) * _ODD[i]
    return _mixed(total)


def profile(h: np.ndarray) -> bytes:
    """How many words fall into each of ``BINS`` bins, 255 at most."""
    return np.minimum(np.bincount((h & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def labelled(grams: np.ndarray) -> np.ndarray:
    """The k-mers told apart by their occurrence: the first, second ... time one stands in a text."""
    order = np.argsort(grams, kind="stable")
    runs = grams[order]
    first = np.r_[True, runs[1:] != runs[:-1]]
    nth = np.arange(len(grams)) - np.maximum.accumulate(np.where(first, np.arange(len(grams)), 0))
    out = np.empty_like(grams)
    out[order] = _mixed(runs + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def keys(grams: np.ndarray) -> list[int]:
    """A text's keys: for each hash its least occurrence-labelled k-mers, ``TAKEN`` of them, in the order of the text.

    Texts near a length from which on more are taken have keys of either kind,
    so that near copies always have keys of one kind in common.
    """
    if not len(grams):
        return []
    n, lengths = len(grams) + K - 1, sorted(TAKEN)
    kinds = [TAKEN[low] for low, high in zip(lengths, [*lengths[1:], math.inf], strict=True) if low <= n and SIMILARITY * n < high]
    out = [_mixed(np.unique(grams))] if 1 in kinds else []
    most = min(max(kinds), len(grams))
    if most == 1:
        return out[0].view(np.int64).tolist()
    x = (labelled(grams) >> np.uint64(32)).astype(np.uint32)
    at = np.empty((KEYS, most), dtype=np.int64)
    step = max(1, CELLS // len(x))
    for a in range(0, KEYS, step):
        v = (x[None, :] ^ _SEEDS[a : a + step, None]) * np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(13)
        v *= np.uint32(0xC2B2AE35)
        rows = np.arange(len(v))
        for j in range(most):
            at[a : a + len(v), j] = least = v.argmin(axis=1)
            v[rows, least] = 0xFFFFFFFF
    for taken in kinds:
        if taken > 1:
            picked = grams[np.sort(at[:, :taken], axis=1)]
            key = np.arange(1, KEYS + 1, dtype=np.uint64) + np.uint64(KEYS * taken)
            for j in range(picked.shape[1]):
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + picked[:, j])
            out.append(key)
    return np.concatenate(out).view(np.int64).tolist()


def allowed(n, m):
    """Words that may be changed, put in or left out between near copies of ``n`` and ``m`` words; arrays too."""
    return np.floor((1 - SIMILARITY) * np.maximum(n, m) + 1e-9).astype(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the edit distance of two sequences of word hashes leaves ``SIMILARITY`` of the longer one in place.

    Common beginnings and ends are cut; counts of equal words, and of equal
    k-mers, of which an edit touches ``K`` at most, bound the rest; then an
    alignment advances furthest-reaching paths within the band of diagonals
    that the distance allows.
    """
    most = int(allowed(len(a), len(b)))
    n = min(len(a), len(b))
    if max(len(a), len(b)) - n > most:
        return False
    differs = np.flatnonzero(a[:n] != b[:n])
    head = int(differs[0]) if len(differs) else n
    a, b, n = a[head:], b[head:], n - head
    differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differs[0]) if len(differs) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    x, y = a.tolist(), b.tolist()
    n, m = len(x), len(y)
    if max(n, m) <= most:
        return True
    if (Counter(x) & Counter(y)).total() < max(n, m) - most:
        return False
    if min(n, m) >= K and (Counter(kmers(a).tolist()) & Counter(kmers(b).tolist())).total() < max(n, m) - K + 1 - K * most:
        return False
    # reach[k]: words of x that the best alignment of d edits has passed on diagonal k = (words of x) - (words of y)
    reach: dict[int, int] = {}
    few = min(most, 8 + math.isqrt(n + m))
    for d in range(few + 1):
        new = {}
        for k in range(max(-d, -m), min(d, n) + 1):
            i = 0 if d == 0 else max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -2))
            i = min(i, n, m + k)
            if i < max(0, k):
                continue
            j = i - k
            while i < n and j < m and x[i] == y[j]:
                i, j = i + 1, j + 1
            if i >= n and j >= m:
                return True
            new[k] = i
        reach = new
    return few < most and _distance_within(x, y, most)


def _distance_within(x: list[int], y: list[int], most: int) -> bool:
    """Whether the edit distance is ``most`` at most, a column of the table at a time, its steps as bits of two numbers."""
    where: dict[int, int] = {}
    for i, word in enumerate(x):
        where[word] = where.get(word, 0) | 1 << i
    full = (1 << len(x)) - 1
    last, up, down, score = 1 << len(x) - 1, full, 0, len(x)
    for left, word in zip(range(len(y) - 1, -1, -1), y, strict=True):
        same = where.get(word, 0)
        stay = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | (full & ~(across | up)), up & across
        score += bool(more & last) - bool(less & last)
        if score - left > most:
            return False
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | (full & ~(stay | more)), more & stay
    return score <= most


@functools.lru_cache(maxsize=64)
def _hashes_of(text: str) -> np.ndarray:
    return hashes_of(text.encode())


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        high, low, found, n_words, profiles = [], [], [], [], []
        for text in batch.column("text"):
            data = (text.as_py() or "").encode()
            digest = xxhash.xxh128_digest(b" ".join(data.split()))
            high.append(int.from_bytes(digest[:8], "big", signed=True))
            low.append(int.from_bytes(digest[8:], "big", signed=True))
            h = hashes_of(data)
            found.append(keys(kmers(h)))
            n_words.append(len(h))
            profiles.append(profile(h))
        out = [batch.column("doc_id"), batch.column("k"), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(n_words, pa.int32()), pa.array(profiles, pa.binary()), pa.array(found, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(out, ["doc_id", "k", "high", "low", "n_words", "profile", "keys"])


def _pairs(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, PAIRS) for b in batches for at in range(0, b.num_rows, PAIRS)):
        rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True)
        links = [(a, b) for a, b, x, y in rows if similar(_hashes_of(x), _hashes_of(y))]
        yield _pairs([x[0] for x in links], [x[1] for x in links])


def _near(one: np.ndarray, n: np.ndarray, two: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether rows of two tables of profiles may be near copies: an edit takes a word out of one bin and puts one into another."""
    gap = one.astype(np.int16) - two
    return np.maximum(gap.clip(0).sum(-1), (-gap).clip(0).sum(-1)) <= allowed(n, m)


def _profiles(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, BINS)


def _screened(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, n, m, one, two = (batch.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "profile_a", "profile_b"))
        near = _near(_profiles(one), np.array(n), _profiles(two), np.array(m)).nonzero()[0].tolist()
        yield _pairs([a[i] for i in near], [b[i] for i in near])


def _screened_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of strays and members that may be similar, from the first bucket that a pair shares.

    Lengths are compared first, then profiles of fewer bins, then whole ones:
    each bounds the distance from below, so none leaves out a near copy.
    """
    for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
        sides, strays, members = [], *(batch.column(c)[0].as_py() for c in ("strays", "members"))
        for rows in (strays, members):
            whole = _profiles([x["profile"] for x in rows])
            # where a text has no key stands its own number, which no other has
            held = np.array([[*x["keys"][:KEYS], *[x["node"]] * (KEYS - len(x["keys"]))] for x in rows], dtype=np.int64)
            sides.append((whole.reshape(len(rows), -1, FOLDED).sum(2, dtype=np.int16), whole, held, *(np.array([x[c] for x in rows]) for c in ("n_words", "node", "root"))))
        (few_a, one, keys_a, n, a, root_a), (few_b, two, keys_b, m, b, root_b) = sides
        met = np.array([[x["whole"] >> j & 1 and j < x["i"] for j in range(KEYS)] for x in strays], dtype=bool)
        step = max(1, CROWD // (BINS * len(b)))
        for at in range(0, len(a), step):
            some = slice(at, at + step)
            near = (np.abs(n[some, None] - m) <= allowed(n[some, None], m)) & (root_a[some, None] != root_b)
            i, j = near.nonzero()
            i += at
            for x, y in ((few_a, few_b), (one, two)):
                left = _near(x[i], n[i], y[j], m[j])
                i, j = i[left], j[left]
            first = ~((keys_a[i] == keys_b[j]) & met[i]).any(1)
            x, y = a[i[first]], b[j[first]]
            yield _pairs(np.minimum(x, y).tolist(), np.maximum(x, y).tolist())


def components(links: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for all nodes of ``links`` (a, b) but the roots.

    Large-star and small-star steps in turn, until the links are stars; each
    round's links are written, and only their number and a checksum are read.
    """

    def star(links: DataFrame, both: bool) -> DataFrame:
        ways = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else links
        centre = ways.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        joined = ways.join(centre, "a")
        if both:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        else:
            out = joined.select(F.inline(F.array(F.struct(F.col("b").alias("a"), F.col("least").alias("b")), F.struct("a", F.col("least").alias("b")))))
        return out.where("a <> b").distinct()

    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = lambda t: tuple(t.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    before = state(links)
    while before[0]:
        links = written(star(star(links, True), False), "links")
        now = state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs of nodes (a, b) whose texts are similar. Only texts of such pairs move."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "doc_id", "k"), "node")
    texts = docs.select(F.col("doc_id").alias("text_id"), F.xxhash64("text").alias("text_k"), "text")
    texts = asked.join(texts, F.col("doc_id").eqNullSafe(F.col("text_id")) & F.col("k").eqNullSafe(F.col("text_k")))
    texts = written(texts.select("node", "text").dropDuplicates(["node"]), "texts")
    found = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    return written(found.mapInArrow(_verified, "a long, b long"), "links")


def _of_large_buckets(members: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Pairs within larger buckets, of other classes so far, that may be similar: those not in a bucket's main class with all others.

    However many these are, all are compared. Buckets of more than ``BLOCK``
    are cut into blocks by length, of which those too unlike don't meet, so
    that a bucket stands in many tasks. Blocks hold profiles, not texts.
    """
    large = members.where("n > 2").join(roots, "node", "left").select("key", "i", "node", "n_words", F.coalesce("root", "node").alias("root"))
    main = large.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.count("*").alias("classes"))
    large = large.join(main.where("classes > 1").select("key", F.col("main.root").alias("main")), "key").withColumn("stray", F.col("root") != F.col("main"))
    # a bit for each of a text's first keys whose bucket is compared
    whole = F.expr(f"bit_or(CASE WHEN i < {KEYS} THEN shiftleft(1L, i) ELSE 0L END)").over(Window.partitionBy("node"))
    mixed = written(large.select("key", "i", "node", "n_words", "root", "stray", whole.alias("whole")), "mixed")
    if mixed.isEmpty():
        return None
    member = F.collect_list(F.struct("node", "root", "n_words", "profile", "stray", "i", "whole", "keys"))
    profiles = nodes.select("node", "profile", F.slice("keys", 1, KEYS).alias("keys"))
    size = mixed.groupBy("key").agg(F.count("*").alias("n"))
    huge = written(size.where(F.col("n") > BLOCK), "huge-buckets")
    # most buckets are a block of their own
    small = mixed.join(huge.select("key"), "key", "left_anti").join(profiles, "node").groupBy("key").agg(member.alias("members"))
    met = small.select(F.filter("members", lambda m: m["stray"]).alias("strays"), "members")
    if not huge.isEmpty():
        # texts whose lengths differ by a factor of 1 / SIMILARITY at most stand in the same class of length or in neighbouring ones
        length = F.floor(F.log(F.greatest("n_words", F.lit(1)).cast("double")) / math.log(1 / SIMILARITY) + 1e-6).cast("int")
        dealt = mixed.join(huge.select("key"), "key").withColumn("length", length)
        blocks = dealt.groupBy("key", "length").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = written(dealt.join(blocks, ["key", "length"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "dealt")
        all_ = written(dealt.join(profiles, "node").groupBy("key", "length", "block").agg(member.alias("members")), "blocks")
        strays = all_.select("key", "length", "block", F.filter("members", lambda m: m["stray"]).alias("strays")).where(F.size("strays") > 0)
        # blocks meet by name first, so that a bucket of many blocks stands in many tasks when their contents are fetched
        ahead = strays.select("key", F.col("length").alias("s_length"), F.col("block").alias("s_block"), F.explode(F.array(*[F.col("length") + i for i in (-1, 0, 1)])).alias("length"))
        names = ahead.join(all_.select("key", "length", "block"), ["key", "length"])
        names = names.join(all_, ["key", "length", "block"]).join(strays.withColumnsRenamed({"length": "s_length", "block": "s_block"}), ["key", "s_length", "s_block"])
        met = met.unionAll(names.select("strays", "members"))
    pairs = written(met.mapInArrow(_screened_blocks, "a long, b long").distinct(), "block-pairs")
    return None if pairs.isEmpty() else pairs


def near_duplicates(docs: DataFrame) -> DataFrame:
    """The class of each document: doc_id, class_id, n_class, kept, k, n_same.

    Two texts are linked if the edit distance of their words, as an alignment
    finds it, is a tenth of the longer one's words at most; a class is what
    links join. Texts of equal words are one node, however they are spaced;
    all texts without words (null ones too) are one. class_id is the least
    doc_id of the class (null if all are), n_class its rows; kept marks one row
    of each class, one of that doc_id. k is a hash of the text, n_same the rows
    that share doc_id and k. Other columns don't return; there is a row for
    each input row.

    Order MinHash deals nodes to buckets: by each of ``KEYS`` hashes the least
    three k-mers (runs of five words, occurrences told apart; two of texts
    under 100 words, all one by one of those under 20) are taken and kept in
    the order of the text. A bucket's members are compared with its
    best-connected one. Members of a larger bucket that are not of
    its main class by then are compared with all members of other classes, in
    blocks where a bucket is large, such as one that a passage of many unlike
    texts makes. So no bucket emits its pairs: lengths and profiles of words,
    which bound the distance from below, leave few pairs, and only these bring
    their texts together to be aligned.
    """
    k = F.xxhash64("text").alias("k")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    sketches = written(docs.select("doc_id", k, "text").mapInArrow(_sketched, f"doc_id {id_type}, k long, high long, low long, n_words int, profile binary, keys array<long>"), "sketches")
    nodes = sketches.groupBy("high", "low").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("of"), F.first(F.struct("n_words", "profile", "keys")).alias("sketch"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "high", "low", "of.doc_id", "of.k", "sketch.*"), "nodes")

    held = nodes.select("node", "n_words", F.col("high").alias("tie"), F.posexplode("keys").alias("i", "key"))
    sizes = held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(held.join(sizes, "key"), "members")
    degree = F.sum("n").over(Window.partitionBy("node"))
    best = F.min(F.struct(-F.col("degree"), "tie", "node", "n_words")).alias("best")
    leaders = members.withColumn("degree", degree).groupBy("key").agg(best, F.count("*").alias("n"))
    leaders = written(leaders.select("key", F.col("best.node").alias("leader"), F.col("best.n_words").alias("leader_words"), "n"), "leaders")
    longer, gap = F.greatest("n_words", "leader_words"), F.abs(F.col("n_words") - F.col("leader_words"))
    pairs = with_key(members.drop("n"), leaders, ["key"], members.count()).where((F.col("node") != F.col("leader")) & (gap <= F.floor(longer * (1 - SIMILARITY) + 1e-9)))
    pairs = pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n_words").alias(f"n_{c}"), F.col("profile").alias(f"profile_{c}"))
    pairs = written(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_screened, "a long, b long"), "pairs")
    roots = components(_linked(pairs, nodes, docs))
    more = _of_large_buckets(members, nodes, roots)
    if more is not None:
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(_linked(more, nodes, docs)))

    placed = nodes.join(roots, "node", "left").select("high", "low", F.struct(F.col("doc_id").isNull(), "doc_id", "k").alias("of"), F.coalesce("root", "node").alias("root"))
    counts = sketches.groupBy("high", "low").agg(F.count("*").alias("n"))
    classes = placed.join(counts, ["high", "low"]).groupBy("root").agg(F.min("of").alias("least"), F.sum("n").alias("n_class"))
    of_node = placed.join(classes, "root").select("high", "low", "least", "n_class")
    same = sketches.groupBy("doc_id", "k", "high", "low").agg(F.count("*").alias("n_same"))
    copies = F.explode(F.sequence(F.lit(1), F.col("n_same").cast("int"))).alias("copy")
    kept = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & F.col("k").eqNullSafe(F.col("least.k")) & (F.col("copy") == 1)
    rows = same.join(of_node, ["high", "low"]).select("doc_id", "k", "n_same", "least", "n_class", copies)
    return rows.select("doc_id", F.col("least.doc_id").alias("class_id"), "n_class", kept.alias("kept"), "k", "n_same")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The input without all but one document of each class of ``near_duplicates``, the one marked kept."""
    kept = written(near_duplicates(docs).where("kept").select(F.col("doc_id").alias("kept_id"), F.col("k").alias("kept_k"), "n_same"), "kept")
    same = F.col("doc_id").eqNullSafe(F.col("kept_id")) & F.xxhash64("text").eqNullSafe(F.col("kept_k"))
    out = docs.join(kept, same, "left_semi")
    if kept.where("n_same > 1").isEmpty():
        return out
    # of rows that agree in doc_id and text the one whose columns hash least stays
    order = F.xxhash64(*[F.col(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString()])
    return out.groupBy("doc_id", F.xxhash64("text").alias("k")).agg(F.min_by(F.struct(*docs.columns), order).alias("row")).select("row.*")
