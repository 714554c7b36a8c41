"""Document fingerprints by consistent weighted sampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import let, written

#: Samples of a fingerprint.
SAMPLES = 32
#: A word's length counts up to this in its weight.
LENGTH_CAP = 63
#: Runs that the ids are cut into, at least and at most; cells of a run and ids of a cell that reach the driver, about;
#: code points of a run and of a task, about.
LEAST_RUNS, MOST_RUNS, CELLS, SAMPLED, RUN_CHARS, TASK_CHARS = 1024, 65_536, 2, 4, 16 << 20, 4 << 20
#: Types of ids: those that have an order and can be written as JSON.
ID_TYPES = (T.IntegralType, T.StringType, T.DecimalType, T.DateType, T.TimestampType, T.TimestampNTZType)
#: The characters between words.
BLANKS = " \t\n\x0b\x0c\r"


def sample(term: Column, ln_weight: Column, k: int) -> Column:
    """The ``k``-th sample's value for a weighted term, as a long whose least one over a text's terms is the text's sample.

    Two hashes of term and ``k`` give five uniform numbers; two pairs of them
    give r and c of Gamma(2, 1), the fifth is beta. t = floor(ln w / r + beta)
    and ln a = ln c - r (t - beta + 1). The upper 32 bits order by ln a, the
    lower ones name (term, t).
    """
    bits = (1 << 21) - 1
    one, two = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    uniform = lambda h, at: (F.shiftrightunsigned(h, at).bitwiseAND(bits) + F.lit(0.5)) / F.lit(float(1 << 21))
    r = -F.log(uniform(one, 0) * uniform(one, 21))
    ln_c = F.log(-F.log(uniform(two, 0) * uniform(two, 21)))
    beta = uniform(two, 42)
    t = F.floor(ln_weight / r + beta)
    ln_a = ln_c - r * (t - beta + 1)
    order = F.floor((ln_a + 100) * (1 << 24))  # ln a lies between -60 and 4
    return F.shiftleft(order, 32).bitwiseOR(F.xxhash64(term, t).bitwiseAND(0xFFFFFFFF))


def fingerprint_pairs(parts: DataFrame, key: list[str], *, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of two texts a row that begin alike.

    ``parts`` has the columns ``key``, unique together, and common, rest and
    other_rest: the texts are common + rest and common + other_rest, and common
    ends where a word ends (it may be empty). A word weighs its occurrences
    times its squared length, so that the short words that all texts of a
    language share count little.

    The result has the key and two arrays, print and other_print, of
    ``samples`` numbers of 32 bits. Two prints agree at a place with the
    probability of the texts' generalised Jaccard similarity (sum of least
    over sum of greatest weights). Texts without words have -1 throughout.

    ``parts`` should be partitioned by the first key column, as
    ``repartition(n, key[0])`` leaves it: then words are counted and samples
    taken where the text lies, and nothing is shuffled.
    """
    words = lambda c: F.split(F.coalesce(F.col(c), F.lit("")), r"[\x20\x09-\x0D]+")
    split = parts.select(*key, words("common").alias("_c"), words("rest").alias("_r"), words("other_rest").alias("_o"))
    word = F.posexplode(F.concat("_c", "_r", "_o")).alias("_at", "_word")
    rows = split.select(*key, F.size("_c").alias("_to_c"), (F.size("_c") + F.size("_r")).alias("_to_r"), word)
    code = F.xxhash64("_word").bitwiseAND(F.lit(-(LENGTH_CAP + 1))).bitwiseOR(F.least(F.length("_word"), F.lit(LENGTH_CAP)).cast("long"))
    at, to_c, to_r = F.col("_at"), F.col("_to_c"), F.col("_to_r")
    counts = (
        rows.select(*key, code.alias("_term"), (at < to_r).cast("long").alias("_a"), ((at < to_c) | (at >= to_r)).cast("long").alias("_b"))
        .groupBy(*key, "_term")
        .agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    )
    length = F.col("_term").bitwiseAND(LENGTH_CAP).cast("double")
    log = lambda n: F.when(F.col(n) * length > 0, F.log(F.col(n) * length * length))
    terms = counts.select(*key, "_term", log("_a").alias("_ln_a"), log("_b").alias("_ln_b"))
    least = [F.min(sample(F.col("_term"), F.col(w), k)).alias(f"{w}_{k}") for k in range(samples) for w in ("_ln_a", "_ln_b")]
    found = terms.groupBy(*key).agg(*least)
    low = lambda w: F.array(*[F.coalesce(F.col(f"{w}_{k}").bitwiseAND(0xFFFFFFFF), F.lit(-1)) for k in range(samples)])
    return found.select(*key, low("_ln_a").alias("print"), low("_ln_b").alias("other_print"))


def likeness(a: Column, b: Column) -> Column:
    """Share of places at which two prints agree."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda n, x: n + x)
    return same / F.size(a).cast("double")


def as_text(fingerprint: Column) -> Column:
    """A print as lowercase hexadecimal digits, eight a sample."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def _cell_of(key: Column, cuts: list[str], key_type: str) -> Column:
    """How many of ``cuts``, ascending JSON values of ``key_type``, ``key`` reaches; by halving."""
    listed = F.from_json(F.lit(f"[{','.join(cuts)}]"), f"array<{key_type}>")

    def found(key: Column, listed: Column, place: Column, step: int) -> Column:
        if not step:
            return place
        return found(key, listed, let(place, lambda p: F.when(F.get(listed, p + (step - 1)) <= key, p + step).otherwise(p)), step // 2)

    # the list is named once, as each name would hold it anew in the plan
    return let(listed, lambda listed: let(key, lambda key: found(key, listed, F.lit(0), 1 << len(cuts).bit_length() >> 1)))


def with_next(docs: DataFrame) -> DataFrame:
    """Each row of doc_id and text with the next row's text, in ascending order of doc_id; after the last comes the first.

    Ids are of any type of ``ID_TYPES``. Some, drawn by a hash, reach the
    driver and cut the order into cells of about equally many rows, wherever
    the ids lie; the cells' sizes reach it too, and neighbouring cells become
    runs of about equal text: ``MOST_RUNS`` x ``CELLS`` x ``SAMPLED`` rows at
    most. One shuffle brings a run together, and the first row of each run goes
    to the run before as well, so that no order over all rows is needed. Null
    ids come first; rows of one id are ordered by a hash of the text, and cut
    by it too.

    Returns run, pos, next_pos (pos is unique), doc_id, text, next_text,
    partitioned by run.
    """
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType
    if not isinstance(id_type, ID_TYPES):
        raise TypeError(f"doc_id is of type {id_type.simpleString()}; ids must be integers, strings, decimals, dates or times")
    key_type = f"struct<s:boolean,i:{id_type.simpleString()},h:bigint>"
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.struct(F.col("doc_id").isNotNull().alias("s"), F.col("doc_id").alias("i"), F.xxhash64("text").alias("h")))
    rows, total = docs.agg(F.count("*"), F.sum(F.length("text") + 64)).first()
    wanted = max(LEAST_RUNS, min(MOST_RUNS, (total or 0) // RUN_CHARS))
    share = min(1.0, wanted * CELLS * SAMPLED / max(1, rows))
    drawn = docs.where(F.pmod(F.xxhash64(F.lit(2), F.col("key")), F.lit(1 << 30)) < int(share * (1 << 30)))
    drawn = drawn.select("key").distinct().sort("key").select(F.to_json("key").alias("cut")).collect()  # so many rows, about
    cuts = [drawn[i]["cut"] for i in sorted({len(drawn) * j // (wanted * CELLS) for j in range(wanted * CELLS)})] if drawn else []
    docs = docs.withColumn("cell", _cell_of(F.col("key"), cuts, key_type))
    cells = sorted(docs.groupBy("cell").agg(F.sum(F.length("text") + 64), F.min("key")).collect(), key=lambda c: c[0])  # a row for each
    runs: list[tuple] = []
    so_far = 0
    for cell, chars, first in cells:
        if so_far * wanted >= total * len(runs):
            runs.append((first, []))
        runs[-1][1].append(cell)
        so_far += chars
    plan = [(cell, r, first, (r - 1) % len(runs)) for r, (first, members) in enumerate(runs) for cell in members]
    key = T.StructType([T.StructField("s", T.BooleanType()), T.StructField("i", id_type), T.StructField("h", T.LongType())])
    plan = spark.createDataFrame(plan, T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("run", T.IntegerType()), T.StructField("first", key), T.StructField("ahead", T.IntegerType())]))
    home = F.struct(F.col("run").alias("run"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("ahead").alias("run"), F.lit(1).alias("guest"))
    leads = F.col("key.i").eqNullSafe(F.col("first.i")) & (F.col("key.h") == F.col("first.h"))
    places = F.when(leads, F.array(home, guest)).otherwise(F.array(home))
    dealt = docs.join(F.broadcast(plan), "cell").select("text", "key", F.inline(places))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // TASK_CHARS)
    order = Window.partitionBy("run").orderBy("guest", "key", "text")
    pos = F.shiftleft(F.col("run").cast("long"), 40) + F.row_number().over(order)
    behind = F.pmod(F.col("run") + 1, F.lit(max(1, len(runs)))).cast("long")
    after = F.when(F.lead("guest").over(order) == 1, F.shiftleft(behind, 40) + 1).otherwise(pos + 1)
    # all that is moved is read by whoever reads the text, so that Spark moves it once for all of them
    seen = dealt.repartition(tasks, "run").select("run", F.col("key.i").alias("doc_id"), "text", "guest", pos.alias("pos"), after.alias("next_pos"), F.lead("text").over(order).alias("next_text"))
    return seen.where("guest = 0").select("run", "pos", "next_pos", "doc_id", "text", "next_text")


def edited_fingerprints(docs: DataFrame, *, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    The edited text has, in place of its last floor(n_chars / 4) code points,
    the first as many (or all) of the next document's. Null texts are empty;
    empty texts are all alike. A table of one row follows itself. Columns of
    the input other than doc_id and text don't matter and don't return.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. A likeness of ``samples`` places estimates a
    similarity J with a standard error of sqrt(J (1 - J) / samples).
    """
    chars = F.length("text")
    rows = with_next(docs.select("doc_id", "text")).select("run", "pos", "next_pos", "doc_id", "text", "next_text", chars.alias("n_chars"), F.floor(chars / 4).cast("int").alias("cut"))
    kept = F.substring("text", F.lit(1), F.col("n_chars") - F.col("cut"))
    added = F.substring("next_text", F.lit(1), F.col("cut"))
    rows = rows.select("run", "pos", "next_pos", "doc_id", "text", "n_chars", kept.alias("kept"), added.alias("added"), (F.col("n_chars") - F.col("cut")).alias("n_kept"))
    about = rows.select("pos", "next_pos", "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.concat("kept", "added"), 256).alias("edited_sha256"))

    # the word that the cut may break: what follows the last blank, looked for in the last 256 characters
    end = F.substring("kept", F.greatest(F.col("n_kept") - 255, F.lit(1)), F.lit(256))
    broken = F.substring_index(F.translate(end, BLANKS, " " * len(BLANKS)), " ", -1)
    n_broken = F.when(F.length(broken) == F.length(end), F.col("n_kept")).otherwise(F.length(broken))
    rows = rows.withColumn("n_common", F.col("n_kept") - n_broken)
    parts = rows.select(
        "run",
        "pos",
        F.substring("kept", F.lit(1), F.col("n_common")).alias("common"),
        F.substring("text", F.col("n_common") + 1, F.col("n_chars")).alias("rest"),
        F.concat(F.substring("kept", F.col("n_common") + 1, F.col("n_kept")), F.col("added")).alias("other_rest"),
    )
    prints = written(about.join(fingerprint_pairs(parts, ["run", "pos"], samples=samples).drop("run"), "pos"), "prints")
    following = prints.select(F.col("pos").alias("next_pos"), F.col("print").alias("next_print"))
    return prints.join(following, "next_pos").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("print")).alias("fingerprint"),
        as_text(F.col("other_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("other_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )
