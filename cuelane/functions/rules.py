"""Many ordered whole-word rules at once: one trie over tokens, whatever the number of rules.

A text is a row of tokens: runs of word characters, and every other character alone. A whole-word match covers whole
tokens, and a replacement never joins its neighbours, so rules act on tokens. The trie finds every rule that a place
begins; rules fire in their order, and what a rule has written is looked up again for later rules only.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = re.compile(r"\w+|\W", re.S)
#: Tokens that a worker remembers with what becomes of them.
SEEN_TOKENS = 500_000


class _Folded(dict):
    """Characters without their case, one for one, so that texts keep their length."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        up = c.upper() if len(c.upper()) == 1 else c
        low = up.lower() if len(up.lower()) == 1 else up
        self[code] = ord(low)
        return self[code]


_FOLD = _Folded()


class _Alone(dict):
    """What becomes of a token by itself, worked out once per token."""

    def __init__(self, trie: _Trie):
        super().__init__()
        self.trie = trie

    def __missing__(self, token: str) -> str:
        if len(self) >= SEEN_TOKENS:
            self.clear()
        self[token] = out = self.trie.together(token)
        return out


class _Trie:
    """Rules whose keys begin and end with word characters. Where no phrase can begin, every token is done by itself."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.values = [_TOKENS.findall(v) for _, v in rules]
        self.root: dict = {}
        self.longest = 1
        for i, (key, _) in enumerate(rules):
            tokens = _TOKENS.findall(key.translate(_FOLD))
            node = self.root
            for t in tokens:
                node = node.setdefault(t, {})
            node.setdefault(None, []).append(i)
            self.longest = max(self.longest, len(tokens))
        self.phrases = {t for t, node in self.root.items() if node.keys() - {None}}
        self.said_phrase = any(t.translate(_FOLD) in self.phrases for v in self.values for t in v)
        self.alone = _Alone(self)

    def apply(self, text: str) -> str:
        if not self.phrases or not self.said_phrase and self.phrases.isdisjoint(_TOKENS.findall(text.translate(_FOLD))):
            return "".join(map(self.alone.__getitem__, _TOKENS.findall(text)))
        return self.together(text)

    def together(self, text: str) -> str:
        tokens, folded = _TOKENS.findall(text), _TOKENS.findall(text.translate(_FOLD))
        if len(tokens) != len(folded):
            folded = [t.translate(_FOLD) for t in tokens]
        root = self.root
        begins = [p for p, t in enumerate(folded) if t in root]
        if not begins:
            return text
        slots: list[list[tuple[str, str]]] = [[x] for x in zip(folded, tokens, strict=True)]  # what now stands where a token was
        waiting: dict[int, set[tuple[int, int]]] = {}
        order: list[int] = []

        def walk(slot: int, at: int):
            """Tokens from a place on, with their places."""
            while slot < len(slots):
                while at < len(slots[slot]):
                    yield slot, at, slots[slot][at][0]
                    at += 1
                slot, at = slot + 1, 0

        def before(slot: int, at: int) -> tuple[int, int] | None:
            while at == 0:
                slot -= 1
                if slot < 0:
                    return None
                at = len(slots[slot])
            return slot, at - 1

        def look(slot: int, at: int, after: int) -> None:
            node = root
            for *_, t in walk(slot, at):
                node = node.get(t)
                if node is None:
                    return
                for i in node.get(None, ()):
                    if i > after:
                        if i not in waiting:
                            waiting[i] = set()
                            heapq.heappush(order, i)
                        waiting[i].add((slot, at))

        def fits(i: int, slot: int, at: int) -> list[tuple[int, int]] | None:
            """The places that rule i covers from here on, if it still matches."""
            if at >= len(slots[slot]):
                return None
            node, seen = root, []
            for s, a, t in walk(slot, at):
                node = node.get(t)
                if node is None:
                    return None
                seen.append((s, a))
                if i in node.get(None, ()):
                    return seen
            return None

        for p in begins:
            look(p, 0, -1)
        while order:
            i = heapq.heappop(order)
            hits, end = [], (-1, -1)
            for place in sorted(waiting.pop(i)):
                seen = fits(i, *place) if place > end else None
                if seen:
                    hits.append(seen)
                    end = seen[-1]
            value = [(t.translate(_FOLD), t) for t in self.values[i]]
            for seen in reversed(hits):  # from the end, so that places in front stay valid
                first = seen[0]
                for s in {s for s, _ in seen[1:] if s != first[0]}:
                    last = max(a for t, a in seen if t == s)
                    slots[s][: last + 1] = []
                here = max(a for s, a in seen if s == first[0])
                slots[first[0]][first[1] : here + 1] = value
            marks = {first[0] for first, *_ in hits}
            for slot in sorted(marks):  # all of a changed slot, and what can reach into it from the left
                places = [(slot, a) for a in range(len(slots[slot]))]
                at = (slot, 0)
                for _ in range(self.longest):  # an emptied place joins what is left and right of it
                    at = before(*at)
                    if at is None:
                        break
                    places.append(at)
                for place in places:
                    look(*place, i)
        return "".join(t for slot in slots for _, t in slot)


class RuleTrie:
    """Rules (key, value): whole words and phrases replaced in any case, rule after rule, a later rule seeing the earlier
    result. Values are taken as they are. A key that begins or ends with another character than a word's is a step of
    its own between tries; an empty key never fires."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.steps: list[Callable[[str], str]] = []
        run: list[tuple[str, str]] = []
        for key, value in [*rules, ("", None)]:
            if re.fullmatch(r"\w(.*\w)?", key, re.S):
                run.append((key, value))
                continue
            if run:
                self.steps.append(_Trie(run).apply)
                run = []
            if key:
                self.steps.append(partial(re.compile(rf"(?i)(?<!\w){re.escape(key)}(?!\w)").sub, lambda _, v=value: v))

    def apply(self, text: str) -> str:
        for step in self.steps:
            text = step(text)
        return text


def by_text(rule: Callable[[str], str]) -> Callable[[Column], Column]:
    """A column function of a rule over texts: each different text of a batch once; null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        codes, different = pd.factorize(texts, use_na_sentinel=True)
        return pd.Series(np.array([*map(rule, different), None], object)[codes])

    return run


def rule_table(rules: list[tuple[str, str]]) -> Callable[[Column], Column]:
    """A column function that applies all rules in order; the trie is built once where the function is made and sent to the tasks with it."""
    return by_text(RuleTrie(rules).apply)
