"""Deletion of repeated runs of lines, found by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, let, with_key, written

#: Words from which on a repeated run of lines is deleted.
MIN_WORDS = 50


def _reach(lines: Column, min_words: int) -> Column:
    """Number of leading ``lines`` that hold ``min_words`` words between them; 0 if all hold fewer."""
    start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("n"))
    return F.aggregate(
        lines,
        start,
        lambda seen, line: F.when(seen["words"] >= min_words, seen).otherwise(F.struct((seen["words"] + line["w"]).alias("words"), (seen["n"] + 1).alias("n"))),
        lambda seen: F.when(seen["words"] >= min_words, seen["n"]).otherwise(F.lit(0)),
    )


def windows_of(text: Column, min_words: int) -> Column:
    """The windows of a text's lines: array of a, b, wh, wg, fp, at.

    A window is a shortest run of non-blank lines, from a line on or up to a
    line, that holds ``min_words`` words; a and b are its first and last line
    numbers, wh and wg hash its content. fp is the least line hash in it and
    ``at`` the number of that line: as it depends on the window's content
    alone, equal windows select equal fingerprints, so no repeated run of
    ``min_words`` words goes without a common one.
    """
    words = lambda line: F.regexp_count(line, F.lit(WORD))
    entry = lambda line, i: F.struct(i.alias("i"), F.xxhash64(line).alias("h"), F.xxhash64(F.lit(7), line).alias("g"), words(line).alias("w"))
    lines = F.filter(F.transform(F.split(text, "\n", -1), entry), lambda line: line["w"] > 0)

    def found(lines: Column) -> Column:
        n = F.size(lines)
        every = F.sequence(F.lit(0), n - 1)
        # a line holds a word at least, so a window holds min_words lines at most
        ahead = F.transform(every, lambda s: F.struct(s.alias("s"), _reach(F.slice(lines, s + 1, min_words), min_words).alias("n")))
        first = lambda e: F.greatest(e - (min_words - 1), F.lit(0))
        behind = F.transform(every, lambda e: let(_reach(F.reverse(F.slice(lines, first(e) + 1, e - first(e) + 1)), min_words), lambda n: F.struct((e - n + 1).alias("s"), n.alias("n"))))
        # the windows up to a line that aren't windows from a line on as well
        both = let(ahead, lambda ahead: F.concat(F.filter(ahead, lambda x: x["n"] > 0), F.filter(behind, lambda x: (x["n"] > 0) & (F.get(ahead, x["s"])["n"] != x["n"]))))

        def window(x: Column) -> Column:
            return let(
                F.slice(lines, x["s"] + 1, x["n"]),
                lambda run: let(
                    F.transform(run, lambda line: line["h"]),
                    lambda hashes: let(
                        F.array_min(hashes),
                        lambda least: F.struct(
                            F.element_at(run, 1)["i"].alias("a"),
                            F.element_at(run, -1)["i"].alias("b"),
                            F.xxhash64(hashes).alias("wh"),
                            F.xxhash64(F.transform(run, lambda line: line["g"])).alias("wg"),
                            least.alias("fp"),
                            F.element_at(run, F.array_position(hashes, least).cast("int"))["i"].alias("at"),
                        ),
                    ),
                ),
            )

        return F.when(n > 0, F.transform(both, window))

    return let(lines, found)


def _placed(text: Column, body) -> Column:
    """``body(words, lines)`` for a text's words and its non-blank lines: i, h, w and at, the place of its first word."""
    entry = lambda line, i: F.struct(i.alias("i"), F.xxhash64(line).alias("h"), F.regexp_count(line, F.lit(WORD)).alias("w"))
    lines = F.filter(F.transform(F.split(text, "\n", -1), entry), lambda line: line["w"] > 0)
    # a word that is the first of its line tells the line's place
    ranks = lambda lines: F.flatten(F.transform(lines, lambda line: F.sequence(F.lit(1), line["w"])))
    places = lambda lines: F.filter(F.transform(ranks(lines), lambda rank, at: F.when(rank == 1, at)), lambda at: at.isNotNull())
    entry_at = lambda line, at: F.struct(line["i"].alias("i"), line["h"].alias("h"), line["w"].alias("w"), at.alias("at"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    return let(words, lambda words: let(let(lines, lambda lines: F.zip_with(lines, places(lines), entry_at)), lambda lines: body(words, lines)))


def sides_of(text: Column, min_words: int) -> Column:
    """The lines of fewer than ``min_words`` words with what stands beside them: array of nth, sides (nth among those not blank).

    A passage of ``min_words`` words around a line of w reaches half of what w
    lacks at least, to one side. A side hashes the line and so many words
    before or after it; it is null where the text ends sooner.
    """

    def found(words: Column, lines: Column) -> Column:
        half = lambda line: F.ceil((min_words - line["w"]) / 2).cast("int")
        reach = lambda line: F.slice(words, line["at"] + 1, line["w"] + half(line))
        after = lambda line: F.when(line["at"] + line["w"] + half(line) <= F.size(words), F.xxhash64(F.lit("after"), line["h"], reach(line)))
        before = lambda line: F.when(line["at"] >= half(line), F.xxhash64(F.lit("before"), line["h"], F.slice(words, F.greatest(line["at"] - half(line), F.lit(0)) + 1, half(line))))
        sides = F.transform(lines, lambda line, nth: F.when(line["w"] < min_words, F.struct(nth.alias("nth"), F.array(before(line), after(line)).alias("sides"))))
        return F.filter(sides, lambda x: x.isNotNull())

    return _placed(text, found)


def passages_of(text: Column, anchors: Column, min_words: int) -> Column:
    """The passages of ``min_words`` words over each of the lines that stand at ``anchors`` among those not blank: array of i, a, b, wh, wg.

    wh and wg hash the words, the line's place among them and the line itself;
    a and b are the first and last line that lie whole in the passage.
    """

    def found(words: Column, lines: Column) -> Column:
        def over(line: Column, n: Column) -> Column:
            first, last = F.greatest(line["at"] + line["w"] - min_words, F.lit(0)), F.least(line["at"], F.size(words) - min_words)
            # a line holds a word at least, so a passage meets min_words lines at most
            near = F.slice(lines, F.greatest(n - min_words, F.lit(0)) + 1, 2 * min_words + 1)

            def passage(near: Column, s: Column) -> Column:
                whole = F.filter(near, lambda x: (x["at"] >= s) & (x["at"] + x["w"] <= s + min_words))
                return let(
                    F.struct(whole.alias("whole"), F.slice(words, s + 1, min_words).alias("words")),
                    lambda x: F.struct(
                        line["i"].alias("i"),
                        F.element_at(x["whole"], 1)["i"].alias("a"),
                        F.element_at(x["whole"], -1)["i"].alias("b"),
                        F.xxhash64(line["h"], line["at"] - s, x["words"]).alias("wh"),
                        F.xxhash64(F.lit(7), line["at"] - s, line["h"], x["words"]).alias("wg"),
                    ),
                )

            return F.when(first <= last, let(near, lambda near: F.transform(F.sequence(first, last), lambda s: passage(near, s))))

        return F.flatten(F.filter(F.transform(anchors, lambda nth: let(F.get(lines, nth), lambda line: over(line, nth))), lambda x: x.isNotNull()))

    return _placed(text, found)


def _extended(rows: DataFrame, min_words: int) -> DataFrame:
    """The passages over lines that stand elsewhere too with the same words on one side: wh, wg, here, a, b."""
    sides = rows.select("doc_id", "k", F.inline(sides_of(F.col("text"), min_words))).select("doc_id", "k", "nth", F.explode("sides").alias("side")).where("side is not null")
    sides = written(sides, "line-sides")
    place = F.xxhash64("doc_id", "k", "nth")
    again = written(sides.groupBy("side").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.count("*").alias("n")).where("x <> y").select("side", "n"), "line-sides-again")
    anchors = with_key(sides, again, ["side"], sides.count()).groupBy("doc_id", "k").agg(F.sort_array(F.collect_set("nth")).alias("anchors"))
    anchors = anchors.withColumnsRenamed({"doc_id": "anchor_id", "k": "anchor_k"})
    texts = rows.join(anchors, F.col("doc_id").eqNullSafe(F.col("anchor_id")) & F.col("k").eqNullSafe(F.col("anchor_k")))
    found = texts.select("doc_id", "k", F.inline(passages_of(F.col("text"), F.col("anchors"), min_words)))
    return written(found.select("wh", "wg", F.struct("doc_id", "k", F.col("i").alias("a")).alias("here"), "a", "b"), "line-passages")


def drop_repeated_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, extend: bool = False) -> DataFrame:
    """Delete from ``text`` each run of lines that stood earlier in the corpus.

    A line goes if it lies in a run of consecutive lines of ``min_words`` words
    or more that also stands at an earlier place; places go by doc_id (nulls
    first), a hash of the text, and line number. Blank lines count for nothing
    and go with a run around them. Lines end at line feeds and must agree in
    every character.

    Winnowing selects each window's least line hash. Where a fingerprint stands
    at one place only, its windows are unique and end there; the other windows
    are joined on their content, whose first place is found by a partial
    aggregate, so nothing is emitted for pairs of places; frequent fingerprints
    and contents are broadcast. All windows over a matched fingerprint take part, which extends a match both ways to the ends
    of the run.

    With ``extend``, runs also go on word by word into the lines around them:
    a line goes, however short, if it lies whole in a passage of ``min_words``
    words, across line ends, that also stands at an earlier place, and the
    passage holds a line that is whole at both places and agrees in every
    character. Lines that such a passage only begins or ends in stay. Lines
    that repeat with the same words on one side are the positions; each match
    is again joined on the passage's content.

    Returns the input's columns with the text that remains, and n_lines,
    n_removed (input columns of these names are replaced). Rows of one doc_id
    and text count as one document and keep the same lines. A null text stays
    null with no lines; an empty text is one blank line; a text that goes
    whole becomes empty.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    rest = [c for c in names if c != "text"]
    rows = docs.select("doc_id", F.xxhash64("text").alias("k"), "text", F.struct(*rest).alias("doc"))
    windows = written(
        rows.select("doc_id", "k", F.inline(windows_of(F.col("text"), min_words)))
        .select("doc_id", "k", "a", "b", "wh", "wg", "fp", F.xxhash64("doc_id", "k", "at").alias("place")),
        "line-windows",
    )
    again = written(windows.groupBy("fp").agg(F.min("place").alias("x"), F.max("place").alias("y"), F.count("*").alias("n")).where("x <> y").select("fp", "n"), "line-hashes")
    matched = written(with_key(windows, again, ["fp"], windows.count()).select("wh", "wg", F.struct("doc_id", "k", "a").alias("here"), "b"), "line-matches").select("wh", "wg", "here", "here.a", "b")
    if extend:
        matched = matched.unionAll(_extended(rows.select("doc_id", "k", "text"), min_words))
    first = matched.groupBy("wh", "wg").agg(F.min("here").alias("first"), F.max("here").alias("last"), F.count("*").alias("n")).where("first <> last")
    first = written(first.select("wh", "wg", "first", "n"), "line-firsts")
    gone = (
        with_key(matched, first, ["wh", "wg"], matched.count())
        .where("here > first")
        .groupBy("here.doc_id", "here.k")
        .agg(F.collect_set(F.struct("a", "b")).alias("runs"))
        .select(
            F.col("doc_id").alias("gone_id"),
            F.col("k").alias("gone_k"),
            F.array_distinct(F.flatten(F.transform("runs", lambda run: F.sequence(run["a"], run["b"])))).alias("gone"),
        )
    )
    lines = F.split("text", "\n", -1)
    left = let(lines, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i)), "\n"))
    kept = [F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias(c) if c == "text" else F.col(f"doc.{c}") for c in names]
    return rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & F.col("k").eqNullSafe(F.col("gone_k")), "left").select(
        *kept,
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
