"""Token ids of whole texts, by the tokenizers library, a word at a time.

A tokenizer that splits a text into words before it merges gives a word the
same ids wherever it stands, so a worker asks the library once for each word it
meets and joins the answers. Texts with characters beyond those for which the
word pattern below is known to split as the library does go to the library
whole, as do all texts of a tokenizer with another configuration.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
from array import array
from itertools import islice

#: Words that a worker remembers; beyond it the half that it met last is dropped.
REMEMBERED = 500_000

# White space, letters and numbers, by Unicode category, among the characters up to U+017F without
# controls, no-break space, soft hyphen and dotted capital I; the contractions of the published word patterns.
BLANK = " \t-\r"
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ſ"
NUMBERS = "0-9²³¹¼-¾"
PLAIN = re.compile("[ -~\t-\r¡-¬®-įı-ſ]*")
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"

#: Patterns by what the configuration asks for: words with the space before them, or words alone in lower case. Either
#: leaves out nothing but plain white space, so a text whose words are plain is plain. Runs that end a word are possessive
#: (++): the same words, and no places are kept to go back to.
SPACED = re.compile(rf" [{LETTERS}]++|[{LETTERS}]++| ?[{NUMBERS}]++|{CONTRACTIONS}| ?[^{BLANK}{LETTERS}{NUMBERS}]++|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]++")
LOWER = re.compile(rf"[{LETTERS}]+|[{NUMBERS}]|{CONTRACTIONS}|[^{BLANK}{LETTERS}{NUMBERS}]+")


_BLANKS = " \t\n\x0b\x0c\r"


def _packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """Encodes texts without added special tokens; special strings inside a text are handled as the library does."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self.special = [t["content"] for t in config["added_tokens"]]
        self.pattern, self.lower = _known(config)
        self.words: dict[str, bytes] = {}
        edge = (lambda t: t.endswith("</w>")) if self.lower else (lambda t: t.startswith("Ġ"))
        self.edges = frozenset(i for t, i in self.library.get_vocab().items() if edge(t))

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [_packed(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, words: list[str]) -> dict[str, bytes]:
        """The ids of words, most of them from one text of them all, which is cut where its tokens say that a word begins or ends."""
        if self.lower:
            joined, text = words, " ".join(words)
        else:
            joined = [w for w in words if w[0] == " " and w[1:2].strip(_BLANKS)]
            text = "".join(joined)
        ids = self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids
        cuts = [i for i, edge in enumerate(map(self.edges.__contains__, ids)) if edge]
        cuts = [0, *(i + 1 for i in cuts)] if self.lower else [*cuts, len(ids)]
        if len(cuts) != len(joined) + 1:
            return dict(zip(words, self._whole(words), strict=True))
        data = _packed(ids)
        found = {w: data[4 * a : 4 * b] for w, a, b in zip(joined, cuts, cuts[1:], strict=False)}
        rest = [w for w in words if w not in found]
        return found | dict(zip(rest, self._whole(rest), strict=True))

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.pattern is None or any(s in text for s in self.special):
            return self._whole([text])[0]
        found = self.pattern.findall(text.lower() if self.lower else text)
        ids = list(map(self.words.get, found))
        if None in ids:
            at = [i for i, known in enumerate(ids) if known is None]
            new = list(dict.fromkeys(found[i] for i in at))
            if not all(map(PLAIN.fullmatch, new)):
                return self._whole([text])[0]
            known = self._each(new)
            if len(self.words) > REMEMBERED:
                self.words = dict(islice(self.words.items(), REMEMBERED // 2))
            self.words.update(known)
            for i in at:
                ids[i] = known[found[i]]
        return b"".join(ids)


def _known(config: dict) -> tuple[re.Pattern | None, bool]:
    """The pattern for a configuration, and whether texts are put in lower case first."""
    model, before, normal = config["model"], config["pre_tokenizer"] or {}, config["normalizer"]
    if model["type"] != "BPE" or model.get("dropout") or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in config["added_tokens"]):
        return None, False
    if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and normal is None:
        return SPACED, False
    steps, parts = [n["type"] for n in (normal or {}).get("normalizers", [])], before.get("pretokenizers", [])
    split = rf"{CONTRACTIONS}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"
    if (
        steps == ["NFC", "Replace", "Lowercase"]
        and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
        and normal["normalizers"][1]["content"] == " "
        and [p["type"] for p in parts] == ["Split", "ByteLevel"]
        and parts[0]["pattern"] == {"Regex": split}
        and (parts[0]["behavior"], parts[0]["invert"]) == ("Removed", True)
        and not parts[1]["use_regex"]
        and not parts[1]["add_prefix_space"]
    ):
        return LOWER, True
    return None, False


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
