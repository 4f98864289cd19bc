"""Exact token ids and counts of white-space separable BPE tokenizers, word by word."""

from __future__ import annotations

import json
import re
import struct
from functools import cached_property

import numpy as np
import regex
from tokenizers import Tokenizer

from tabsmith.llm.common import resident
from tabsmith.llm.prefixes import Merges, prefix_counts

#: Words that one worker keeps the ids of, twice (a young and an old half), and as many parts of words.
CACHE_WORDS = 200_000
#: Characters whose normal form, lower case and class are the same in every library.
_PLAIN = re.compile("[!-~¡-įı-ɏ]+").fullmatch


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, rest = {b: chr(b) for b in own}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(rest)
            rest += 1
    return [letters[b] for b in range(256)]


def separable(spec: dict) -> bool:
    """Whether a tokenizer file splits texts at white space, drops it, and treats the parts apart."""
    normal = spec.get("normalizer") or {}
    pre = spec.get("pre_tokenizer") or {}
    steps = [x.get("type") for x in normal.get("normalizers", [])]
    parts = pre.get("pretokenizers", [])
    return (
        steps == ["NFC", "Replace", "Lowercase"]
        and normal["normalizers"][1].get("content") == " "
        and [x.get("type") for x in parts] == ["Split", "ByteLevel"]
        and parts[0].get("behavior") == "Removed"
        and parts[0].get("invert") is True
        and not parts[1].get("add_prefix_space")
        and parts[1].get("use_regex") is False
        and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens", []))
        and [*regex.findall(r"\\p\{L\}|\\p\{N\}|'\w+", parts[0]["pattern"]["Regex"])] == ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", r"\p{L}", r"\p{N}", r"\p{L}", r"\p{N}"]
        and not any(any(c.isspace() for c in x["content"]) for x in spec.get("added_tokens", []))
    )


class _Memo(dict):
    """Ids of the words met so far: at most `CACHE_WORDS` young ones, and as many old ones that a use makes young again."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode
        self.old: dict = {}

    def __missing__(self, word):
        ids = self.old.get(word)
        if ids is None:
            ids = self.encode(word)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


class WordTokenizer:
    """Ids of a text as the ids of its words, one after another.

    The vocabulary drops white space and never joins over it, so a text's ids are those of its words. Each
    distinct word is encoded once by the library and kept in a cache of bounded size. Plain Latin
    words go straight to the library's merge model after the file's own lower-casing and splitting; all other words
    (other scripts, combining marks, special strings) go through the library's whole pipeline.
    """

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        if not separable(spec):
            raise ValueError("this tokenizer does not treat the words between white space apart")
        self.whole = Tokenizer.from_str(text)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.model = self.whole.model
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in spec.get("added_tokens", [])) or "(?!)").search
        self.letters = _byte_letters()
        encode = self.encode
        self.memo = _Memo(lambda word: encode(word.decode(errors="replace")))
        self.units = _Memo(self._unit)
        self.specials = regex.compile("|".join(regex.escape(x["content"]) for x in spec.get("added_tokens", [])) or "(?!)").finditer
        self._spec = spec["model"]
        self.prefix_memo: dict[str, np.ndarray] = {}

    @cached_property
    def merges(self) -> Merges:
        """Built where a count inside a word is first asked for."""
        return Merges(self._spec, self.letters)

    def prefixes(self, word: str, limit: int | None = None) -> np.ndarray:
        """Token counts of all prefixes of a word (a text without ASCII white space), the empty one first; with a limit, the longest
        ones may be left out where all of them have more tokens."""
        found = self.prefix_memo.get(word)
        if found is None:
            if limit is not None:
                return np.array(prefix_counts(self.merges, self.specials, word, limit), np.int64)
            found = np.array(prefix_counts(self.merges, self.specials, word), np.int64)
            if len(self.prefix_memo) >= CACHE_WORDS:
                self.prefix_memo.clear()
            if len(word) <= 64:
                self.prefix_memo[word] = found
        return found

    def _unit(self, unit: str) -> bytes:
        name = unit if unit.isascii() else "".join([self.letters[b] for b in unit.encode()])
        tokens = self.model.tokenize(name)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def encode(self, word: str) -> bytes:
        """Ids of a text without white space, as little-endian 32-bit numbers."""
        if _PLAIN(word) and not self.special(word):
            low = word.lower()
            if low.isalpha():
                return self.units[low]
            return b"".join(map(self.units.__getitem__, self.split(low)))
        return np.array(self.whole.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word."""
        return list(map(self.memo.__getitem__, words))

    def ids(self, text: bytes) -> bytes:
        """Ids of a text."""
        return b"".join(map(self.memo.__getitem__, text.split()))


def word_tokenizer(text: str) -> WordTokenizer:
    """The worker's tokenizer of a file's content; its cache lives until the worker turns to another stage."""
    return resident(text, lambda: WordTokenizer(text))


def tokenizer_text(path: str) -> str:
    """The content of a tokenizer file, read once on the driver and sent along with the tasks."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if not separable(json.loads(text)):
        raise ValueError(f"{path}: this tokenizer does not treat the words between white space apart")
    return text
