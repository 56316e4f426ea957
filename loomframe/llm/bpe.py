"""Exact byte-pair encoding without replaying merges over whole words.

A sequence of tokens is the encoding of their text if and only if every token re-merges to itself and every adjacent
pair re-merges to itself: until the first merge across a border, both sides evolve alone. So longest matches with a
compatibility check of neighbours, or a table over prefixes, find the encoding exactly.
"""

from __future__ import annotations

import ahocorasick

#: Marks the end of a word inside this module; it is never part of a vocabulary file's text.
WORD_END = chr(0xE000)


class Merges:
    """Plain merging of short symbol lists by rank, leftmost first; the ground truth of the checks below."""

    def __init__(self, rank, keep: int = 1_000_000) -> None:
        self.rank = rank  # (left, right) -> number or None
        self.keep = keep
        self.pairs: dict[tuple[str, str], bool] = {}
        self.histories: dict[str, tuple] = {}

    @staticmethod
    def symbols(text: str) -> list[str]:
        if text.endswith(WORD_END) and len(text) > 1:
            return [*text[:-2], text[-2:]]
        return list(text)

    def merge(self, text: str) -> list[str]:
        parts = self.symbols(text)
        rank, none = self.rank, float("inf")
        ranks = [none if (r := rank(a, b)) is None else r for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != none:
            at = ranks.index(best)
            joint = parts[at] + parts[at + 1]
            parts[at : at + 2] = [joint]
            del ranks[at]
            if at:
                r = rank(parts[at - 1], joint)
                ranks[at - 1] = none if r is None else r
            if at < len(ranks):
                r = rank(joint, parts[at + 1])
                ranks[at] = none if r is None else r
        return parts

    def _history(self, token: str) -> tuple[str, str, list[tuple[float, str, str]]]:
        """First and last symbol of a token, and the rank, first and last symbol after each of its merges in turn."""
        found = self.histories.get(token)
        if found is None:
            parts = self.symbols(token)
            first, last, steps = parts[0], parts[-1], []
            rank, none = self.rank, float("inf")
            while len(parts) > 1:
                ranks = [none if (r := rank(x, y)) is None else r for x, y in zip(parts, parts[1:], strict=False)]
                if (best := min(ranks)) == none:
                    break
                at = ranks.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                steps.append((best, parts[0], parts[-1]))
            if len(self.histories) >= self.keep:
                self.histories.clear()
            found = self.histories[token] = first, last, steps
        return found

    def _apart(self, left: str, right: str) -> bool:
        """Merges both tokens anew, side by side and in order of rank, until the pair across their border would merge.
        Of equal ranks the leftmost merges first: left's before the border's, the border's before right's."""
        _, last, one = self._history(left)
        first, _, two = self._history(right)
        rank, none = self.rank, float("inf")
        i = j = 0
        across = rank(last, first)
        while True:
            a = one[i][0] if i < len(one) else none
            b = two[j][0] if j < len(two) else none
            if across is not None and across < a and across <= b:
                return False
            if a <= b:
                if a == none:
                    return True
                if one[i][2] != last:
                    last = one[i][2]
                    across = rank(last, first)
                i += 1
            else:
                if two[j][1] != first:
                    first = two[j][1]
                    across = rank(last, first)
                j += 1

    def compatible(self, left: str, right: str) -> bool:
        """Whether the two tokens stay apart when their joint text is merged anew. Both merge to themselves alone."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= self.keep:
                self.pairs.clear()
            whole = right == WORD_END  # the mark alone would be one symbol with the character before it
            known = self.pairs[key] = self.merge(left + right) == [left, right] if whole else self._apart(left, right)
        return known


def automaton(tokens) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for t in tokens:
        found.add_word(t, t)
    found.make_automaton()
    return found


class BacktrackEncoder:
    """Longest match first; where neighbours aren't compatible, the next shorter prefix; where none is left, one step
    back. A bitfield keeps the positions from which no encoding exists, so that each fails once only."""

    def __init__(self, tokens, merges: Merges) -> None:
        self.merges = merges
        self.tokens = {t for t in tokens if len(t) == 1 or merges.merge(t) == [t]}
        self.matches = ahocorasick.Automaton()
        for t in self.tokens:
            if len(t) > 1:  # a character by itself is what a position begins with
                self.matches.add_word(t, (len(t) - 1, t))
        self.matches.make_automaton()
        self._shorter: dict[str, str | None] = {}

    def shorter(self, token: str) -> str | None:
        """The longest proper prefix that is a token."""
        if token not in self._shorter:
            self._shorter[token] = next((token[:n] for n in range(len(token) - 1, 0, -1) if token[:n] in self.tokens), None)
        return self._shorter[token]

    def encode(self, text: str) -> list[str]:
        """Tokens of text; a character that is in no token stands alone."""
        known = self.tokens
        if text in known:
            return [text]
        longest = list(text)  # by start
        if len(text) > 1:
            for end, (back, token) in self.matches.iter(text):
                longest[end - back] = token  # ends come in ascending order
        out: list[str] = []
        at, n = 0, len(text)
        failed = bytearray(n + 1)
        token, last = longest[0] if n else None, None
        compatible, checked, shorter = self.merges.compatible, self.merges.pairs, self._shorter
        while at < n:
            while token is not None:
                end = at + len(token)
                if not failed[end]:
                    if last is None:
                        break
                    fits = checked.get((last, token))
                    if fits is None:
                        fits = last not in known or token not in known or compatible(last, token)
                    if fits:
                        break
                token = shorter[token] if token in shorter else self.shorter(token)
            if token is None:
                failed[at] = 1
                token = out.pop()
                last = out[-1] if out else None
                at -= len(token)
            else:
                out.append(token)
                last, at = token, end
                token = longest[at] if at < n else None
        return out


class PrefixTable:
    """Token counts of every prefix of a word by dynamic programming: the last token of a prefix is the one match
    ending there that is compatible with the last token of the prefix before it."""

    def __init__(self, tokens, merges: Merges) -> None:
        self.merges = merges
        self.tokens = {t for t in tokens if len(merges.symbols(t)) == 1 or merges.merge(t) == [t]}
        self.matches = automaton(t for t in self.tokens if not t.endswith(WORD_END))
        self.longest_end = max((len(t) for t in self.tokens if t.endswith(WORD_END)), default=1) - 1

    def body(self, word: str) -> tuple[list[str], list[int]]:
        """For every prefix that isn't the word's end: its last token and its number of tokens."""
        last, count = [""] * (len(word) + 1), [0] * (len(word) + 1)
        compatible = self.merges.compatible
        for end, token in self.matches.iter(word):
            start, end = end + 1 - len(token), end + 1
            if not last[end] and (start == 0 or (last[start] and compatible(last[start], token))):
                last[end], count[end] = token, count[start] + 1
        return last, count

    def closed(self, word: str, end: int, last: list[str], count: list[int]) -> int:
        """Number of tokens of word[:end] as a word of its own."""
        for start in range(max(0, end - self.longest_end), end):
            token = word[start:end] + WORD_END
            if token in self.tokens and (start == 0 or (last[start] and self.merges.compatible(last[start], token))):
                return count[start] + 1
        raise ValueError(f"no encoding of {word[:end]!r}")

    def total(self, word: str) -> int:
        return self.closed(word, len(word), *self.body(word[:-1]))

    def every(self, word: str) -> list[int]:
        """Number of tokens of each prefix word[:i], i from 0, each as a word of its own."""
        last, count = self.body(word)
        return [0] + [self.closed(word, i, last, count) for i in range(1, len(word) + 1)]
