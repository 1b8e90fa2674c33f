"""BPE encoding and decoding by an automaton whose arcs are tokens.

The merges are compiled one after the other. At first one state has an arc back to itself for each symbol: every
sequence of symbols is a path. The gadget of a merge (u, v) gives all arcs u a new end, a copy of the state that they
led to without its arc v, and beside each path u v an arc for the merged token to where that v led. What is left is
deterministic and has, for each text, one path: its tokens. All arcs of a token have the same end, so that a state is
a token and how many of its copies were made; a copy is stored as the one arc that it lost and when.

Words are read symbol by symbol through the automaton over symbols that follows: its states are the unfinished arcs,
kept as numbers, and its transitions are table entries, filled as they are first taken. An entry names the token that
ends the reading up to there, so the tokens of a word are read off backwards. Decoding writes the labels of the arcs.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import fresh

#: Entries of a worker's tables, after which they are begun anew; what they hold can always be made again.
STATES = 180_000
WORDS = 120_000
#: Longer words are not kept in the table of words.
LONG_WORD = 100
SEPARATORS = "\x1c\x1d\x1e\x1f"


class Vocabulary(NamedTuple):
    """What a tokenizer's file says, in a form that tasks can be sent: at most some megabytes."""

    labels: tuple[str, ...]
    merges: bytes  # rows of three 32-bit ids: left, right, merged
    plain: tuple[int, ...]  # id of each byte's symbol inside a word
    last: tuple[int, ...]  # id of each byte's symbol at a word's end
    added: tuple[tuple[str, int], ...]
    split: str
    parts: str  # the file's own normaliser and splitter


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it is visible in Latin-1, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(hidden)) for b in range(256)]


def vocabulary(path: str) -> Vocabulary:
    """Reads a ``tokenizers`` file of a BPE over bytes with word ends, NFC and lower case; ValueError for another kind."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, before, norm = spec["model"], spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
    splitters, norms = before.get("pretokenizers", []), norm.get("normalizers", [])
    known = (
        model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix")
        and not model.get("ignore_merges") and not model.get("dropout") and spec.get("decoder") is None
        and [s["type"] for s in splitters] == ["Split", "ByteLevel"] and splitters[0]["invert"] and splitters[0]["behavior"] == "Removed"
        and not splitters[1]["add_prefix_space"] and not splitters[1]["use_regex"]
        and [n["type"] for n in norms] == ["NFC", "Replace", "Lowercase"] and norms[1]["pattern"] == {"Regex": r"\s+"}
        and not any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in spec["added_tokens"])
    )
    if not known:
        raise ValueError(f"{path}: not a byte-level BPE with word ends over lower-cased words")
    ids, end = model["vocab"], model["end_of_word_suffix"]
    added = tuple((a["content"], a["id"]) for a in spec["added_tokens"])
    labels = [""] * (1 + max([*ids.values(), *[i for _, i in added]]))
    for label, i in [*ids.items(), *added]:
        labels[i] = label
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int32).reshape(-1, 3)
    symbols = byte_symbols()
    parts = {"version": "1.0", "added_tokens": [], "normalizer": norm, "pre_tokenizer": splitters[0], "model": {"type": "BPE", "vocab": {}, "merges": []}}
    plain, last = tuple(ids[s] for s in symbols), tuple(ids[s + end] for s in symbols)
    return Vocabulary(tuple(labels), merges.tobytes(), plain, last, added, splitters[0]["pattern"]["Regex"], json.dumps(parts))


class Automaton:
    """The automaton over tokens that the merges make, and the table-driven one over symbols."""

    START = 1 << 31
    OPEN = -1

    def __init__(self, symbols: dict[int, int], merges) -> None:
        """``symbols`` gives the token of each symbol; ``merges`` are (left, right, merged) tokens in their order."""
        self.made = dict.fromkeys([self.START, *symbols.values()], -1)  # the merge that made a token's arcs
        self.halves: dict[int, tuple[int, int]] = {}
        self.lost: dict[int, dict[int, int]] = {}  # by token: arc that a copy of its end lost, and at which merge
        self.spelt = {token: (s,) for s, token in symbols.items()}
        for k, (u, v, w) in enumerate(merges):
            if u not in self.spelt or v not in self.spelt or w in self.spelt:
                raise ValueError(f"merge {k} of {u} and {v} to {w}: its parts must be there before it, and the whole must be new")
            self.spelt[w] = self.spelt[u] + self.spelt[v]
            if u in self.made and v in self.made and self.arc(u, k, v):
                self.lost.setdefault(u, {})[v] = k
                self.made[w], self.halves[w] = k, (u, v)
        self.child: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.length = {t: len(x) for t, x in self.spelt.items()}
        for token in self.made:
            if token != self.START:
                self._spell(token)
        self._anew()

    def arc(self, token: int, time: int, label: int) -> bool:
        """Whether the state that ``token`` leads to after merge ``time`` has an arc ``label``.

        A copy has what its original had, but for one arc; a merged arc stands beside the arc of its left half; the
        arcs of a merged token lead where its right half led when it was made.
        """
        while True:
            if self.lost.get(token, {}).get(label, time + 1) <= time:
                return False
            if self.made[label] > self.made[token]:
                time = min(time, self.made[label])
                label = self.halves[label][0]
            elif token not in self.halves:
                return True
            else:
                time = self.made[token] - 1
                token = self.halves[token][1]

    def _spell(self, token: int) -> None:
        node = 0
        for s in self.spelt[token]:
            at = self.child[node].get(s)
            if at is None:
                at = self.child[node][s] = len(self.ends)
                self.ends.append(None)
                self.child.append({})
            node = at
        self.ends[node] = token

    def _anew(self) -> None:
        # A state is what is unfinished in it: tokens read last, each with a place in what may follow. Its entries are a
        # dictionary from symbols to the next state's entries and the token that ends there; OPEN leads back to the state.
        self.states: dict[tuple[int, ...], dict] = {}
        self.follows: dict[int, bool] = {}
        self.start = self._state((self.START << 32,))

    def _state(self, unfinished: tuple[int, ...]) -> dict:
        entries = self.states.get(unfinished)
        if entries is None:
            entries = self.states[unfinished] = {self.OPEN: unfinished}
        return entries

    def _follows(self, token: int, label: int) -> bool:
        pair = token << 32 | label
        known = self.follows.get(pair)
        if known is None:
            known = self.follows[pair] = self.arc(token, len(self.spelt), label)
        return known

    def _enter(self, entries: dict, symbol: int) -> tuple[dict, int]:
        """Fills the entry for ``symbol``: the next state, and the token that ends there."""
        unfinished, ended, after = entries[self.OPEN], None, []
        child, ends = self.child, self.ends
        for pair in unfinished:
            at = child[pair & 0xFFFFFFFF].get(symbol)
            if at is None:
                continue
            if ended is None and ends[at] is not None and self._follows(pair >> 32, ends[at]):
                ended = ends[at]
            if child[at]:
                after.append(pair & ~0xFFFFFFFF | at)
        if len(self.states) >= STATES:
            self._anew()
            entries = self._state(unfinished)
        after.append(ended << 32)
        entry = entries[symbol] = self._state(tuple(after)), ended
        return entry

    def tokens(self, symbols) -> list[int]:
        """The tokens of one word."""
        entries, ended = self.start, []
        for s in symbols:
            entry = entries.get(s) or self._enter(entries, s)
            entries = entry[0]
            ended.append(entry[1])
        out, at, length = [], len(ended), self.length
        while at:
            token = ended[at - 1]
            out.append(token)
            at -= length[token]
        return out[::-1]


class Recent(dict):
    """The last WORDS entries that were made or used, and as many before them."""

    def __init__(self) -> None:
        super().__init__()
        self.before: dict = {}

    def keep(self, key: str, value: tuple[int, ...]) -> None:
        if len(self) >= WORDS:
            self.before = dict(self)
            self.clear()
        self[key] = value

    def recalled(self, key: str) -> tuple[int, ...] | None:
        """An entry of the table before, which is then a new one again."""
        value = self.before.get(key)
        if value is not None:
            self.keep(key, value)
        return value


class Encoder:
    """A vocabulary's automaton with the tables of one worker."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        # Symbols are bytes; 256 more at the end of a word.
        symbols = {b: i for b, i in enumerate((*v.plain, *v.last))}
        self.automaton = Automaton(symbols, np.frombuffer(v.merges, np.int32).reshape(-1, 3).tolist())
        self.split = regex.compile(v.split)
        self.letters = r"|[\p{L}]+|" in v.split  # letters alone are one word
        self.added = dict(v.added)
        names = sorted(self.added, key=len, reverse=True)
        self.marks = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None
        self.words, self.runs = Recent(), Recent()
        self.spaces = regex.compile(r"\s+")
        self.assigned: set[str] = set()
        self.library = None

    def words_of(self, text: str) -> list[str]:
        """The words of a text without added tokens, normalised.

        Characters that this Python's Unicode tables lack are left to the library's own splitter.
        """
        if not text.isascii():
            new = set(text) - self.assigned
            if any(unicodedata.category(c) == "Cn" for c in new):
                return self._by_library(text)
            self.assigned |= new
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final form of sigma
        text = text.lower()
        return [text] if self.letters and text.isalpha() else self.split.findall(text)

    def _by_library(self, text: str) -> list[str]:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.v.parts)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def word(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word) or self.words.recalled(word)
        if ids is None:
            ids = self._read(word)
            if len(word) <= LONG_WORD:
                self.words.keep(word, ids)
        return ids

    def _read(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        return tuple(self.automaton.tokens((*raw[:-1], raw[-1] + 256)))

    def run(self, run: str) -> tuple[int, ...]:
        """Ids of a text without white space: no word and no composed character reaches over white space."""
        ids = self.runs.recalled(run)
        if ids is None:
            words = self.words_of(run)
            # A run that is a word is kept once, as a run.
            ids = self._read(run) if words == [run] else tuple(i for w in words for i in self.word(w))
            if len(run) <= LONG_WORD:
                self.runs.keep(run, ids)
        return ids

    def ids(self, text: str) -> list[int]:
        out: list[int] = []
        known = self.runs
        for part in self.marks.split(text) if self.marks and any(a in text for a in self.added) else (text,):
            if part in self.added:
                out.append(self.added[part])
                continue
            # Python counts four separators as white space that the pattern doesn't.
            for run in self.spaces.split(part) if any(c in part for c in SEPARATORS) else part.split():
                ids = known.get(run)
                out.extend(self.run(run) if ids is None else ids)
        return out


@lru_cache(maxsize=2)
def encoder(v: Vocabulary) -> Encoder:
    """Compiled once in each worker."""
    return Encoder(v)


def encoded(docs: DataFrame, v: Vocabulary, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with ``into``, the token ids of each whole text; null and empty texts have none.

    Every row stays, once, with its columns; ``into`` gets an underscore while a column has that name. Strings of added
    tokens in a text are those tokens. No row is shuffled.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(v)
        for texts in batches:
            yield pd.Series([np.array(e.ids(t), np.int32) for t in texts])

    return docs.withColumn(fresh(docs, into), ids(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def decoded(df: DataFrame, v: Vocabulary, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with ``into``, the labels of the ids with a space between; null ids give the empty text.

    An id that the vocabulary doesn't have is left out, as the library does.
    """

    @F.pandas_udf("string")
    def labels(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of, n = v.labels, len(v.labels)
        for rows in batches:
            yield pd.Series([" ".join([of[i] for i in r if 0 <= i < n and of[i]]) for r in (x.tolist() for x in rows)])

    return df.withColumn(fresh(df, into), labels(F.coalesce(F.col(ids), F.expr("cast(array() as array<int>)"))))
