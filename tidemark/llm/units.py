"""Encoding whole texts through the tokenizers library, one distinct unit at a time.

A text is cut before a space that a visible character follows. Both kinds of tokenizers used here start
a new piece there (a byte-level tokenizer joins that space to what follows, a word tokenizer drops it), so the ids
of a text are those of its units one after another. Units repeat, and each task encodes a distinct one
once while it stays in a bounded cache. Strings of special tokens are cut out first, as the library does.

Most unknown units are a plain word with or without marks behind it. Marks are a piece of their own for both
kinds, so such a unit is its word and its marks, and a plain word is a single piece: it goes to the library's model directly,
spared the normalizer and the splitting rules that would leave it as it is. For tokenizers that drop white space and case,
Arrow cuts a batch of texts into units, numbers the distinct ones and lowers their case (WordEncoder).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: A word of Latin letters that no normalizer composes anew, then marks other than apostrophes.
_WORD, _MARKS = "[A-Za-zÀ-ÖØ-öø-ĮıĲ-ɏ]+", "[.,!?;:|$%&*#]*"
_PLAIN = re.compile(f"({_WORD})({_MARKS})")
_PLAIN_RE2 = f"^(?P<word>{_WORD})(?P<marks>{_MARKS})$"

CACHE_UNITS = 800_000

_OPEN: dict[tuple, "UnitEncoder | WordEncoder"] = {}


def encoder(path: str, cache_units: int = CACHE_UNITS, long_unit: int = 0, encode_long: Callable | None = None) -> "UnitEncoder | WordEncoder":
    """The encoder of this worker process for a tokenizer file; it is kept between tasks."""
    key = (path, cache_units, long_unit)
    if key not in _OPEN:
        made = UnitEncoder(path, cache_units, long_unit, encode_long)
        _OPEN[key] = WordEncoder(made) if made.drops_space and not long_unit else made
    return _OPEN[key]


class _Index(dict):
    """Unit to its number; an unknown one gets the next number and waits to be encoded."""

    def __init__(self):
        self.waiting: list[str] = []
        self.given = 0

    def __missing__(self, unit: str) -> int:
        self[unit] = number = self.given
        self.given += 1
        self.waiting.append(unit)
        return number


class UnitEncoder:
    def __init__(self, path: str, cache_units: int, long_unit: int, encode_long: Callable | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        added = described["added_tokens"]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            raise ValueError("special tokens that take in their surroundings are not supported")
        self.special = {t["content"]: t["id"] for t in added}
        self.special_pattern = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        self.plain, self.drops_space = _plain_form(described)
        self.bare = Tokenizer(self.tokenizer.model)
        self.cache_units, self.long_unit, self.encode_long = cache_units, long_unit, encode_long
        self._reset()

    def _reset(self) -> None:
        self.index = _Index()
        self.lengths, self.starts, self.flat, self.filled = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def _forget(self, added: list[str], asked: int) -> None:
        """Keep cache_units units, or start anew where most of what is kept was of no use."""
        over = self.index.given - self.cache_units
        if over <= 0:
            return
        if len(added) > asked / 5:
            return self._reset()
        for key in added[len(added) - over :]:
            del self.index[key]
        self.index.given = self.cache_units
        self.filled = int(self.starts[self.cache_units - 1] + self.lengths[self.cache_units - 1])

    def _unit(self, key: str) -> str:
        return key[2:] if key.startswith("\n\0") else " " + key

    def _units_of(self, text: str, out: list) -> None:
        if self.drops_space:  # then any cut in white space will do
            out.extend(map(self.index.__getitem__, text.replace("\n", " ").split(" ")))
            return
        for k, line in enumerate(re.split(r"(?<=\S)\n(?=\S)", text) if "\n" in text else [text]):  # a lone line feed is a piece
            if k:
                out.append(self.index["\n\0\n"])
            words = line.split(" ")
            if "" in words[1:] or re.search(r" \s", line):
                words = re.split(r" (?=\S)", line)
            # a first unit has no space before it, so it is another unit than the same word later on; no later unit starts with a line feed
            out.append(self.index["\n\0" + words[0]])
            out.extend(map(self.index.__getitem__, words[1:]))

    def _encode_waiting(self) -> None:
        waiting = self.index.waiting
        if not waiting:
            return
        parts, short, words, index = {}, [], [], self.index
        for i, key in enumerate(waiting):  # parts that are unknown join the end of the list
            if self.plain and (m := _PLAIN.fullmatch(key, 2 * (key[:2] == "\n\0"))):
                word = m[1].lower() if self.drops_space else key[: m.end(1)]
                if m[2] or word != key:
                    parts[i] = (index[word], index["\n\0" + m[2]] if m[2] else -1)
                    continue
                if not self.long_unit or len(key) <= self.long_unit:
                    words.append(i)
                    continue
            short.append(i)
        self.index.waiting = []
        base, ids = self.index.given - len(waiting), [None] * len(waiting)
        units = {i: self._unit(waiting[i]) for i in short}
        long = [i for i in short if self.long_unit and len(units[i]) > self.long_unit]
        for i in long:
            ids[i] = self.encode_long(self.tokenizer, units[i])
        for chosen, tokenizer, string in ((sorted(set(short) - set(long)), self.tokenizer, units.__getitem__), (words, self.bare, lambda i: self.plain(waiting[i]))):
            for at in range(0, len(chosen), 4096):
                some = chosen[at : at + 4096]
                for i, e in zip(some, tokenizer.encode_batch_fast([string(i) for i in some], add_special_tokens=False), strict=True):
                    ids[i] = e.ids
        known = lambda n: ids[n - base] if n >= base else self.flat[self.starts[n] : self.starts[n] + self.lengths[n]].tolist()
        for i, (word, marks) in sorted(parts.items(), reverse=True):
            ids[i] = known(word) + known(marks) if marks >= 0 else known(word)
        units = waiting
        first, last = self.index.given - len(units), self.index.given
        if last > len(self.lengths):
            size = max(last, 2 * len(self.lengths))
            self.lengths, self.starts = np.resize(self.lengths, size), np.resize(self.starts, size)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self.lengths[first:last], self.starts[first:last] = sizes, self.filled + np.cumsum(sizes) - sizes
        more = int(sizes.sum())
        if self.filled + more > len(self.flat):
            self.flat = np.resize(self.flat, max(self.filled + more, 2 * len(self.flat)))
        self.flat[self.filled : self.filled + more] = np.fromiter(chain.from_iterable(ids), np.uint32, more)
        self.filled += more

    def _sizes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
        """Units of the texts, the number of ids of each, the units before each text's end, and special tokens by place."""
        out: list[int] = []
        ends, special = np.zeros(len(texts), np.int64), {}
        for i, text in enumerate(texts):
            if text:
                if "<|" in text and (parts := self.special_pattern.split(text))[1:]:
                    for p in parts:
                        if p in self.special:
                            special[len(out)] = self.special[p]
                            out.append(0)
                        elif p:
                            self._units_of(p, out)
                else:
                    self._units_of(text, out)
            ends[i] = len(out)
        if special and not self.index.given:
            self.index["x"]
        self.added = self.index.waiting
        self._encode_waiting()
        units = np.array(out, np.int64)
        sizes = self.lengths[units]
        sizes[list(special)] = 1
        return units, sizes, ends, special

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text; null is the empty text."""
        units, sizes, ends, _ = self._sizes(texts)
        self._forget(self.added, len(units))
        return np.diff(np.concatenate([[0], np.cumsum(sizes)])[ends], prepend=0)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the number of ids of each; null is the empty text."""
        units, sizes, ends, special = self._sizes(texts)
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.starts[units] - (stops - sizes), sizes)] if total else np.zeros(0, np.uint32)
        for at, token in special.items():
            ids[stops[at] - 1] = token
        self._forget(self.added, len(units))
        return ids, np.diff(np.concatenate([[0], stops])[ends], prepend=0)


class WordEncoder:
    """The same results as the UnitEncoder given, for a tokenizer that drops white space and case: any space and line feed is a cut.

    Units are split, numbered and lowered by Arrow, so that Python handles a distinct word of a slice of texts
    once. What it keeps between slices are ids of words and of runs of marks; a unit is one of each.
    """

    def __init__(self, base: UnitEncoder):
        self.tokenizer, self.bare, self.plain, self.cache_units = base.tokenizer, base.bare, base.plain, base.cache_units
        vocabulary, suffix = self.bare.get_vocab(), getattr(self.bare.model, "end_of_word_suffix", None)
        self.ends = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._reset()

    def _reset(self) -> None:
        self.number = {"": 0}  # the empty string, a unit between two spaces, has no ids
        self.lengths, self.starts, self.flat, self.filled = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32), 0

    def _numbers(self, strings: pa.StringArray, plain: np.ndarray) -> np.ndarray:
        """The number of each string; unknown ones are encoded: plain words by the model, others by the whole tokenizer."""
        coded = strings.dictionary_encode()
        names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        number = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(number < 0)
        self.added += len(new)
        if len(new):
            is_plain = np.zeros(len(names), bool)
            is_plain[codes] = plain
            words, others = new[is_plain[new]], new[~is_plain[new]]
            ids, sizes = [], []
            for at in range(0, len(words), 4096):
                found = self._words([self.plain(names[i]) for i in words[at : at + 4096].tolist()])
                ids.append(found[0])
                sizes.append(found[1])
            for at in range(0, len(others), 4096):
                found = [e.ids for e in self.tokenizer.encode_batch_fast([names[i] for i in others[at : at + 4096].tolist()], add_special_tokens=False)]
                ids.append(np.fromiter(chain.from_iterable(found), np.uint32))
                sizes.append(np.fromiter(map(len, found), np.int64, len(found)))
            self._keep(np.concatenate(ids), np.concatenate(sizes))
            order = np.concatenate([words, others])
            number[order] = np.arange(len(self.number), len(self.number) + len(order))
            self.number.update(zip(map(names.__getitem__, order.tolist()), number[order].tolist()))
        return number[codes]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words and the number of each. A list of words is one encoding, cut where a token ends a word."""
        if self.ends.any():
            ids = np.array(self.bare.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, np.uint32)
            stops = 1 + np.flatnonzero(self.ends[ids])
            if len(stops) == len(words) and stops[-1] == len(ids):
                return ids, np.diff(stops, prepend=0)
        found = [e.ids for e in self.bare.encode_batch_fast(words, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def _keep(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        first, last = len(self.number), len(self.number) + len(sizes)
        if last > len(self.lengths):
            size = max(last, 2 * len(self.lengths))
            self.lengths, self.starts = np.resize(self.lengths, size), np.resize(self.starts, size)
        self.lengths[first:last], self.starts[first:last] = sizes, self.filled + np.cumsum(sizes) - sizes
        if self.filled + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, max(self.filled + len(ids), 2 * len(self.flat)))
        self.flat[self.filled : self.filled + len(ids)] = ids
        self.filled += len(ids)

    def _forget(self, asked: int) -> None:
        """Keep cache_units strings, or start anew where most of what is kept was of no use."""
        over = len(self.number) - self.cache_units
        if over <= 0:
            return
        if self.added > asked / 5 or self.cache_units < 2:
            return self._reset()
        for _ in range(over):
            self.number.popitem()  # the last added
        self.filled = int(self.starts[self.cache_units - 1] + self.lengths[self.cache_units - 1])

    def _parts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers for each unit of the texts, and the numbers before each text's end."""
        self.added = 0
        units = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.string()).fill_null(""), "\n", " "), " ")
        coded = units.flatten().dictionary_encode()
        found = pc.extract_regex(coded.dictionary, _PLAIN_RE2)
        plain = found.is_valid()
        words = self._numbers(pc.if_else(plain, pc.utf8_lower(found.field("word")), coded.dictionary), plain.to_numpy(zero_copy_only=False))
        marks = self._numbers(pc.if_else(plain, found.field("marks"), ""), np.zeros(len(plain), bool))
        return np.stack([words, marks], axis=1)[coded.indices.to_numpy()].ravel(), 2 * units.offsets.to_numpy()[1:].astype(np.int64)

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text; null is the empty text."""
        parts, ends = self._parts(texts)
        n = np.diff(np.concatenate([[0], np.cumsum(self.lengths[parts])])[ends], prepend=0)
        self._forget(len(parts))
        return n

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the number of ids of each; null is the empty text."""
        parts, ends = self._parts(texts)
        sizes = self.lengths[parts]
        stops = np.cumsum(sizes)
        total = int(stops[-1]) if len(stops) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.starts[parts] - (stops - sizes), sizes)] if total else np.zeros(0, np.uint32)
        n = np.diff(np.concatenate([[0], stops])[ends], prepend=0)
        self._forget(len(parts))
        return ids, n


def _plain_form(described: dict) -> tuple[Callable[[str], str] | None, bool]:
    """The string that a tokenizer's model gets for a unit that is a plain word (None where its rules are
    others), and whether the tokenizer drops white space and case."""
    visible = {b: chr(b) for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    of_byte = {b: visible.get(b) or chr(256 + sum(x not in visible for x in range(b))) for b in range(256)}
    mapped = lambda word: word if word.isascii() else word.encode().decode("latin-1").translate(of_byte)
    before, cut = described["normalizer"], described["pre_tokenizer"] or {}
    if before is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]:
        return (lambda key: mapped(key[2:]) if key[:2] == "\n\0" else of_byte[32] + mapped(key)), False
    steps = [x["type"] for x in (before or {}).get("normalizers", [])], [x["type"] for x in cut.get("pretokenizers", [])]
    if steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) and cut["pretokenizers"][0]["behavior"] == "Removed" and not cut["pretokenizers"][1]["use_regex"]:
        return mapped, True
    return None, False


def in_slices(texts: list[str | None], chars: int = 2_000_000):
    """Slices of a batch by characters, so that a task holds little beside one batch, whatever the texts' lengths."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= chars:
            yield start, texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]
