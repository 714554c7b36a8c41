"""Token counts by a tokenizer compiled to a finite-state transducer.

Byte-pair encoding leaves no two neighbouring tokens that would merge
otherwise if they stood alone, and a text has one sequence of tokens with that
property. So the last token of a text's encoding follows from the last tokens
of the encodings of its beginnings, and a deterministic transducer can read a
text and hold, after each character, how many tokens the text so far has.

A state of the merges names the beginnings that may still grow into a token:
for each, the node of the vocabulary's trie that spells what follows it, its
last token, and its number of tokens against the present one. A transition is
annotated with the change of the count (a merge may lower it). States of the
word pattern (letters, numbers, other signs, white space, an apostrophe that
may begin a contraction) stand around these. States and transitions are
compiled when a text first asks for them and kept.

A long text is read in chunks. A chunk's map takes the state before it to the
state after it and a count; from the first place on at which a word begins
whatever stood before, all states agree, so a map is its head up to there, a
count and a state. Maps compose associatively, and are reduced in pairs. The
chunks of a very long text are mapped by many tasks; only maps come together.
"""

from __future__ import annotations

import json
import os
import pickle
import re
from collections.abc import Iterable, Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Characters of a chunk; states (a kilobyte each, about) and pairs of tokens that a worker keeps before it compiles anew.
CHUNK, STATES, PAIRS = 4096, 500_000, 400_000
#: Characters from which on a text's pieces are mapped by different tasks, and of such a piece.
SPLIT, PIECE = 1 << 20, 1 << 17
# Letters, digits and other signs but the apostrophe, as the library's pattern sees them too.
_LETTER, _DIGIT, _SIGN = "A-Za-z\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3", "0-9", "!-&(-/:-@\\[-`{-~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f"
#: Two characters of which the second begins a word, or a run of blanks, whatever stood before them.
RESET = re.compile(f"[!-~¡-ᙿ][ \t-\r]|[{_LETTER}][{_DIGIT}{_SIGN}]|[{_DIGIT}][{_LETTER}{_SIGN}]|[{_SIGN}][{_LETTER}{_DIGIT}]")
_ROOT = 0


class Row(dict):
    """Transitions of one state by character: the next row and the change of the count. Missing ones are compiled."""

    __slots__ = ("key", "owner")

    def __missing__(self, char: str):
        return self.owner.compile(self, char)


class Transducer:
    """Counts the tokens of texts as the library does for a byte-level vocabulary file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import pre_tokenizers

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        before = config["pre_tokenizer"] or {}
        if config["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or not before["use_regex"] or before["add_prefix_space"] or config["normalizer"] or config["model"].get("ignore_merges"):
            raise ValueError(f"{path}: not a byte-level vocabulary that splits text by the published pattern")
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.specials = sorted((t["content"] for t in config["added_tokens"]), key=len, reverse=True)  # of two that begin alike the longer one counts
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        self._compile_vocabulary(config["model"])
        self._compatible: dict[tuple[int, int], bool] = {}
        self.kinds: dict[str, str] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all states."""
        self.rows: dict[tuple, Row] = {}
        self.start = self.row(("start",))

    # the vocabulary and its merges

    def _compile_vocabulary(self, model: dict) -> None:
        of_char = {c: b for b, c in _byte_chars().items()}
        self.bytes_of = {i: bytes(of_char[c] for c in t) for t, i in model["vocab"].items() if all(c in of_char for c in t)}
        id_of = {b: i for i, b in self.bytes_of.items()}
        self.single = {b[0]: i for b, i in id_of.items() if len(b) == 1}
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {}
        for rank, (x, y) in enumerate(merges):
            self.merges.setdefault((model["vocab"][x], model["vocab"][y]), (rank, model["vocab"][x + y]))
        self.children: list[dict[int, int]] = [{}]
        self.token = [-1]
        for spelled, i in id_of.items():
            node = _ROOT
            for byte in spelled:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.token)
                    self.children.append({})
                    self.token.append(-1)
                node = self.children[node][byte]
            self.token[node] = i

    def merged(self, data: bytes) -> list[int]:
        """The encoding of one word, by merging the pair of least rank, leftmost first."""
        ids = [self.single[b] for b in data]
        while len(ids) > 1:
            rank, at = min((self.merges.get(pair, (1 << 60, 0))[0], i) for i, pair in enumerate(zip(ids, ids[1:], strict=False)))
            if rank == 1 << 60:
                break
            ids[at : at + 2] = [self.merges[ids[at], ids[at + 1]][1]]
        return ids

    def follows(self, a: int, b: int) -> bool:
        """Whether token ``b`` may stand after token ``a``."""
        found = self._compatible.get((a, b))
        if found is None:
            if len(self._compatible) > PAIRS:
                self._compatible.clear()
            found = self._compatible[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return found

    # states of the merges: tuples of (trie node, last token, count against the present)

    EMPTY = ((_ROOT, -1, 0),)

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        """The state after one more character of a word, and the change of its number of tokens."""
        now, total = state, 0
        for byte in char.encode():
            grown, last, count = [], -1, 0
            for node, before, n in now:
                node = self.children[node].get(byte)
                if node is None:
                    continue
                token = self.token[node]
                if token >= 0 and last < 0 and (before < 0 or self.follows(before, token)):
                    last, count = token, n + 1
                if self.children[node]:
                    grown.append((node, before, n))
            now = (*((node, before, n - count) for node, before, n in grown), (_ROOT, last, 0))
            total += count
        return now, total

    # states of the word pattern

    def kind(self, char: str) -> str:
        """L, N, S or P: a letter, number, blank or other sign. The library's own splitting says which."""
        if char not in self.kinds:
            joins = {kind: len(self.split(base + char)) == 1 for kind, base in (("L", "a"), ("N", "1"), ("P", "!"))}
            self.kinds[char] = next((k for k, joined in joins.items() if joined), "S")
        return self.kinds[char]

    def row(self, key: tuple) -> Row:
        if key not in self.rows:
            row = self.rows[key] = Row()
            row.key, row.owner = key, self
        return self.rows[key]

    def compile(self, row: Row, char: str) -> tuple[Row, int]:
        if len(self.rows) > STATES:
            key = row.key
            self.clear()
            row = self.row(key)
        key, change = self._next(row.key, char, self.kind(char))
        row[char] = self.row(key), change
        return row[char]

    def _begin(self, char: str, kind: str, state: tuple = EMPTY) -> tuple[tuple, int]:
        """A word's first character, perhaps after the space in ``state``."""
        after, n = self.step(state, char)
        if kind == "S":
            return ("blank", self.EMPTY, char), n
        if char == "'" and state is self.EMPTY:
            return ("apostrophe", after), n
        return ("word", kind, after), n

    def _next(self, key: tuple, char: str, kind: str) -> tuple[tuple, int]:
        if key[0] == "word" and kind == key[1]:
            state, n = self.step(key[2], char)
            return ("word", kind, state), n
        if key[0] == "blank":
            # of a run of blanks before a word the last is left out; a space then begins the word
            run, last = key[1], key[2]
            joined, n = self.step(run, last)
            if kind == "S":
                return ("blank", joined, char), self.step(joined, char)[1]
            if last == " ":
                key, begun = self._begin(char, kind, self.step(self.EMPTY, " ")[0])
                return key, begun + self.step(self.EMPTY, " ")[1] - n
            key, begun = self._begin(char, kind)
            return key, begun + self.step(self.EMPTY, last)[1] - n
        if key[0] == "apostrophe":
            if char in "stmd":
                return ("start",), self.step(key[1], char)[1]
            if kind == "P":
                state, n = self.step(key[1], char)
                return ("word", "P", state), n
            if char in "rvl":
                return ("contraction", key[1], char), self.step(self.EMPTY, char)[1]
        if key[0] == "contraction":
            quote, first = key[1], key[2]
            alone, n_alone = self.step(self.EMPTY, first)
            if first + char in ("re", "ve", "ll"):
                one, n_one = self.step(quote, first)
                return ("start",), n_one + self.step(one, char)[1] - n_alone
            return self._next(("word", "L", alone), char, kind)
        return self._begin(char, kind)

    # reading texts

    def run(self, text: str, row: Row) -> tuple[int, Row]:
        """The change of the count over ``text`` from the state ``row`` on, and the state after it."""
        n = 0
        for char in text:
            row, change = row[char]
            n += change
        return n, row

    def chunk_map(self, text: str, first: bool = False) -> tuple[str, int, tuple | None]:
        """A chunk's map: its head, the count after the head and the state after the chunk (None: all of it is head)."""
        if first:
            n, row = self.run(text, self.start)
            return "", n, row.key
        reset = RESET.search(text)
        if not reset:
            return text, 0, None
        last = text[reset.end() - 1]
        n, row = self.run(text[reset.end() :], self.row(self._begin(last, self.kind(last))[0]))
        return text[: reset.end()], n, row.key

    def compose(self, one: tuple, two: tuple) -> tuple:
        """The map of two chunks, one after the other."""
        head, n, key = one
        if key is None:
            return head + two[0], two[1], two[2]
        m, row = self.run(two[0], self.row(key))
        return head, n + m + two[1], row.key if two[2] is None else two[2]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """The number of tokens of a text; special strings in it are tokens."""
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self._count(part, chunk) for part in parts)

    def _count(self, text: str, chunk: int) -> int:
        if len(text) <= chunk:
            return self.run(text, self.start)[0]
        return self.reduced([self.chunk_map(text[at : at + chunk], at == 0) for at in range(0, len(text), chunk)])[1]

    def reduced(self, maps: list[tuple]) -> tuple:
        """The map of all chunks, in order: neighbours are composed in pairs, then pairs of pairs."""
        while len(maps) > 1:
            maps = [a if b is None else self.compose(a, b) for a, b in zip_longest(maps[::2], maps[1::2])]
        return maps[0]


def _byte_chars() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_transducers: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """This worker's transducer for a vocabulary file."""
    if path not in _transducers:
        _transducers[path] = Transducer(path)
    return _transducers[path]


def _counted(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = transducer(path).count
        for batch in batches:
            texts = [text.as_py() or "" for text in batch.column("text")]
            n_bytes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n_bytes, pa.array([count(t) for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _mapped(path: str, chunk: int):
    """The map of each piece, from the maps of its chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            found = []
            for text, i in zip(batch.column("piece").to_pylist(), batch.column("i").to_pylist(), strict=True):
                maps = [machine.chunk_map(text[at : at + chunk], i == 0 and at == 0) for at in range(0, len(text), chunk)]
                found.append(pickle.dumps(machine.reduced(maps)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "n_bytes", "i")), pa.array(found, pa.binary())], ["doc_id", "row", "n_bytes", "i", "map"])

    return run


def _composed(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for batch in batches:
            counts = [machine.reduced([pickle.loads(m["map"]) for m in maps])[1] for maps in batch.column("maps").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, *, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of each whole text.

    Counts are those of the tokenizers library for the vocabulary file
    ``tokenizer`` (byte-level), without added special tokens, special strings
    inside a text being tokens. Null texts are empty; empty texts have none.
    Rows are counted where they lie, one for one; other columns don't return.
    Texts of more than ``SPLIT`` characters without special strings are cut
    into pieces, which any task may map; a text's maps, which hold a piece's
    text only as far as no word surely begins, are then composed.
    """
    id_type, schema = docs.schema["doc_id"].dataType.simpleString(), "n_bytes long, n_tokens long"
    docs = docs.select("doc_id", "text")
    special = F.lit(False)
    for s in transducer(tokenizer).specials:
        special = special | F.col("text").contains(s)
    split = F.coalesce((F.length("text") > SPLIT) & ~special, F.lit(False))
    rows = docs.where(~split).mapInArrow(_counted(tokenizer), f"doc_id {id_type}, {schema}")
    long = docs.where(split)
    if not long.isEmpty():
        n_bytes, ends = F.octet_length("text").cast("long").alias("n_bytes"), F.sequence(F.lit(0), F.floor((F.length("text") - 1) / PIECE).cast("int"))
        pieces = long.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), n_bytes, ends.alias("ends"))
        pieces = pieces.select("doc_id", "text", "row", "n_bytes", F.explode("ends").alias("i"))
        pieces = written(pieces.select("doc_id", "row", "n_bytes", "i", F.substring("text", F.col("i") * PIECE + 1, F.lit(PIECE)).alias("piece")), "pieces")
        maps = pieces.repartition("row", "i").mapInArrow(_mapped(tokenizer, CHUNK), f"doc_id {id_type}, row long, n_bytes long, i int, map binary")
        whole = maps.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.array_sort(F.collect_list(F.struct("i", "map"))).alias("maps"))
        rows = rows.unionAll(whole.select("doc_id", "n_bytes", "maps").mapInArrow(_composed(tokenizer), f"doc_id {id_type}, {schema}"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
