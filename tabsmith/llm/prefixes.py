"""Exact token counts at every prefix of a word, by dynamic programming over byte-pair merges.

A text cut anywhere ends in a word part whose last letter carries the end mark. Byte-pair encodings have the property that a
sequence of tokens is the encoding of their joined letters if it is so for every two neighbours. So of all tokens that
end at a place exactly one can be the last token there: the one that follows the last token of the place where it begins.
That gives count(place) = count(place - length of the token) + 1, for parts without the end mark (which longer prefixes go on from)
and, from them, for parts with it. Whether two tokens may be neighbours is worked out once and kept.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex

#: Answers that a worker keeps: neighbours that may follow each other.
KEPT_PAIRS = 1_000_000
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_END = ""
_NEVER = 1 << 30


@lru_cache(maxsize=65536)
def kind_of(letter: str) -> int:
    """What the splitting pattern takes a letter for."""
    if regex.match(r"\p{White_Space}", letter):
        return _SPACE
    return _LETTER if regex.match(r"\p{L}", letter) else _DIGIT if regex.match(r"\p{N}", letter) else _OTHER


@lru_cache(maxsize=1)
def _joining() -> frozenset[str]:
    """Letters that may become one with a letter before them in normal form C."""
    second = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
    for c in range(0x30000):
        parts = unicodedata.decomposition(chr(c))
        if parts and not parts.startswith("<") and len(parts.split()) == 2:
            second.add(chr(int(parts.split()[1], 16)))
    return frozenset(second)


@lru_cache(maxsize=65536)
def opens(letter: str) -> bool:
    """Whether nothing before a letter changes its normal form, and it changes nothing before it."""
    return letter < chr(0x300) or (not unicodedata.combining(letter) and letter not in _joining())


class Merges:
    """The merge rules of a vocabulary with an end mark, and the tokens by their last letters."""

    def __init__(self, model: dict, byte_letters: list[str]) -> None:
        self.mark = model["end_of_word_suffix"]
        self.byte_letters = byte_letters
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): n for n, m in enumerate(model["merges"])}
        self.inner: dict = {}
        self.final: dict = {}
        for token in model["vocab"]:
            ends = token.endswith(self.mark)
            node = self.final if ends else self.inner
            for letter in reversed(token.removesuffix(self.mark) if ends else token):
                node = node.setdefault(letter, {})
            node[_END] = token
        #: Letters of the longest token: whatever goes on from a place passes within so many letters behind it.
        self.longest = max(map(len, model["vocab"]))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.known: dict[str, tuple[list, list] | None] = {}

    def letters(self, c: str) -> str:
        return "".join([self.byte_letters[b] for b in c.encode()])

    def edges(self, token: str) -> tuple[list, list] | None:
        """How a token comes to be by merges of its letters: its last symbol at each stage and the rank of the merge that takes it up, and
        the same for its first symbol. None if the merges do not lead to the token."""
        found = self.known.get(token, 0)
        if found == 0:
            symbols = [*token.removesuffix(self.mark)]
            if token.endswith(self.mark):
                symbols[-1] += self.mark
            last, first = [], []
            while len(symbols) > 1:
                rank, at = min((self.rank.get(p, _NEVER), n) for n, p in enumerate(zip(symbols[:-1], symbols[1:], strict=True)))
                if rank == _NEVER:
                    break
                if at == len(symbols) - 2:
                    last.append((symbols[-1], rank))
                if at == 0:
                    first.append((symbols[0], rank))
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            found = ([*last, (token, _NEVER)], [*first, (token, _NEVER)]) if symbols == [token] else None
            self.known[token] = found
        return found

    def follows(self, before: str, token: str) -> bool:
        """Whether `token` may follow `before` ("": may stand alone)."""
        found = self.pairs.get((before, token))
        if found is None:
            found = self.edges(token) is not None and (not before or self._apart(before, token))
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            self.pairs[before, token] = found
        return found

    def _apart(self, before: str, token: str) -> bool:
        """Whether no merge ever joins the last symbol of one token with the first of the next: at each stage, the merge of the two would
        have to come before the merges that take either up into its own token (of equal ones, the left one comes first)."""
        left, right = self.edges(before)[0], self.edges(token)[1]
        i = j = 0
        while True:
            (x, x_taken), (y, y_taken) = left[i], right[j]
            rank = self.rank.get((x, y), _NEVER)
            if rank < x_taken and rank <= y_taken and rank < _NEVER:
                return False
            if x_taken == y_taken == _NEVER:
                return True
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1


class Part:
    """A word part that grows letter by letter (of its normal form); `count` is the number of its tokens if it ended here."""

    def __init__(self, merges: Merges) -> None:
        self.merges = merges
        self.base, self.kind, self.pending = 0, "", ""
        self._start()

    def _start(self) -> None:
        # Byte letters of the open piece, and for each of its prefixes the last token and the count, without the end mark.
        self.open, self.last, self.counts, self.ended = [], [""], [0], 0

    @property
    def count(self) -> int:
        return self.base + self.ended + (1 if self.pending else 0)

    @property
    def least(self) -> int:
        """No longer prefix has fewer tokens."""
        window = self.counts[-self.merges.longest :]
        return self.base + (min(window) if len(self.counts) > self.merges.longest else 0)

    def state(self) -> tuple:
        return self.base, self.kind, self.pending, self.open, self.last, self.counts, self.ended, len(self.open)

    def back_to(self, state: tuple) -> None:
        self.base, self.kind, self.pending, self.open, self.last, self.counts, self.ended, size = state
        del self.open[size:], self.last[size + 1 :], self.counts[size + 1 :]

    def _close(self, kind: str) -> None:
        self.base += self.ended
        self.kind = kind
        self._start()

    def _extend(self, c: str) -> None:
        follows, last, counts, letters = self.merges.follows, self.last, self.counts, self.open
        for letter in self.merges.letters(c):
            letters.append(letter)
            for size, token in self._ending(self.merges.inner):
                at = len(letters) - size
                if follows(last[at], token):
                    last.append(token)
                    counts.append(counts[at] + 1)
                    break
        for size, token in self._ending(self.merges.final):
            at = len(letters) - size
            if follows(last[at], token):
                self.ended = counts[at] + 1
                return

    def _ending(self, node: dict) -> list[tuple[int, str]]:
        """Tokens that end with the open piece, longest first."""
        found, letters = [], self.open
        for k in range(len(letters) - 1, -1, -1):
            node = node.get(letters[k])
            if node is None:
                break
            if _END in node:
                found.append((len(letters) - k, node[_END]))
        return found[::-1]

    def add(self, c: str) -> None:
        """One letter more. The pieces are 's 't 're 've 'm 'll 'd, runs of letters, single digits and runs of anything else but spaces."""
        kind = kind_of(c)
        if self.pending:
            before, self.pending = self.pending, ""
            if before + c in ("re", "ve", "ll"):
                self._extend(before)
                self._extend(c)
                self.kind = "done"
                return
            self._close("letters")
            self._extend(before)
        if kind == _SPACE:
            self._close("")
        elif kind == _LETTER:
            if self.kind == "quote" and c in "stmd":
                self._extend(c)
                self.kind = "done"
            elif self.kind == "quote" and c in "rvl":
                # A quote and a letter, unless the next one makes it a piece.
                self.pending = c
            else:
                if self.kind != "letters":
                    self._close("letters")
                self._extend(c)
        elif kind == _DIGIT:
            self._close("done")
            self._extend(c)
        else:
            if self.kind not in ("other", "quote"):
                self._close("quote" if c == "'" else "other")
            else:
                self.kind = "other"
            self._extend(c)


def counts_of_part(merges: Merges, text: str, upto: int, limit: int = _NEVER) -> list[int]:
    """Tokens of text[:0], text[:1], ..., text[:upto], for a text without special strings; ends early where all longer prefixes have more
    than `limit`."""
    part, out, start = Part(merges), [0], 0
    while start < upto and (start % 64 or part.least <= limit):
        end = start + 1
        while end < len(text) and not opens(text[end]):
            end += 1
        before, normal = part.state(), ""
        for k in range(start + 1, min(end, upto) + 1):
            c = text[k - 1]
            if normal and unicodedata.combining(c) and unicodedata.combining(c) == unicodedata.combining(normal[-1]):
                # A mark of the same class as the one before stays where it is.
                new, normal = c, normal + c
            else:
                if k > start + 1:
                    part.back_to(before)
                new = normal = unicodedata.normalize("NFC", text[start:k])
            for x in new:
                for y in x.lower():
                    part.add(y)
            out.append(part.count)
        start = end
    return out


def prefix_counts(merges: Merges, special, word: str, limit: int = _NEVER) -> list[int]:
    """Tokens of word[:0], word[:1], ..., the whole word; `special` finds special strings, which count as one token each. Ends early where
    all longer prefixes have more than `limit`."""
    out, start = [0], 0
    for low, high in [*(m.span() for m in special(word)), (None, len(word))]:
        base, upto = out[start], high - start - (low is not None)
        # A special string that is cut is plain text.
        out += [base + n for n in counts_of_part(merges, word[start:high], upto, limit - base)[1:]]
        if len(out) <= start + upto:
            break
        if low is not None:
            out.append(out[low] + 1)
        start = high
    return out
