"""Token ids of texts by a file of the tokenizers library."""

from __future__ import annotations

import json
import os
import re
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE = "word_bpe_49k.json"
EDGE = r"([a-zß-öø-į])([!-&(-/:-@\[-`{-~])"


def public_tokenizer(name: str = WORD_BPE) -> str:
    """Path of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class TextEncoder:
    """Encodes batches of texts; the ids are those of ``Tokenizer.encode(text, add_special_tokens=False)``.

    A tokenizer that drops white space and ends each word with a suffix never joins text over a blank, so such
    texts are cut at blanks and each different word of a task is encoded once. Words are kept in a table of at
    most ``room`` entries. Any other tokenizer gets the texts as they are.
    """

    def __init__(self, file: str, room: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(file)
        self.room = room
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        self.by_word = bool(suffix) and self._drops_blanks()
        self.letters = self._whole_letters() if self.by_word else {}
        if self.letters:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = CharDelimiterSplit(" ")
            units = self.tokenizer.get_vocab()
            self.last = np.zeros(max(units.values()) + 1, np.bool_)
            self.last[[i for unit, i in units.items() if unit.endswith(suffix)]] = True
        # Latin letters whose lower case is the same character by character here and in the library.
        self.unusual = re.compile("[^\x00-įı-ɏ]|<\\|")
        self._empty()

    def _drops_blanks(self) -> bool:
        ids = self._one("a b\n\nc")
        return ids == self._one("a") + self._one("b") + self._one("c")

    def _whole_letters(self) -> dict[int, str]:
        """Latin letters that need no normalising and stay in one unit, each with the form it has in the model. A word
        of these alone goes to the model without the library's other steps."""
        change, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        if change is None or cut is None:
            return {}
        same = [c for c in map(chr, range(0x250)) if c.isalpha() and change.normalize_str(c) == c]
        found = {c: cut.pre_tokenize_str(c) for c in same}
        forms = {c: pieces[0][0] for c, pieces in found.items() if len(pieces) == 1}
        both = "".join(forms) + "".join(reversed(forms))
        whole = [form for form, _ in cut.pre_tokenize_str(both)] == ["".join(forms[c] for c in both)]
        return {ord(c): form for c, form in forms.items()} if whole and change.normalize_str(both) == both else {}

    def _one(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _empty(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.again = np.zeros(1 << 14, np.bool_)
        self.used = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        if not self.by_word:
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts
        words = pc.split_pattern(self._prepared(texts), " ")
        values = words.values.dictionary_encode()
        found = self._numbers(values.dictionary.to_numpy(zero_copy_only=False).tolist())
        numbers = found[values.indices.to_numpy(zero_copy_only=False)]
        parts, upto = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for at in range(0, len(numbers), 1 << 17):  # parts that stay in a core's cache
            some = numbers[at : at + (1 << 17)]
            lengths = self.length.take(some)
            ends = np.cumsum(lengths)
            places = np.repeat(self.start.take(some) - (ends - lengths), lengths)
            places += np.arange(len(places))
            parts.append(self.flat.take(places))
            upto.append(ends + upto[-1][-1])
        return np.concatenate(parts), np.diff(np.concatenate(upto).take(words.offsets.to_numpy()))

    def _prepared(self, texts: list[str]) -> pa.Array:
        """Texts whose words lie between blanks; in usual ones also a sign after a letter is cut off, as it always
        begins a unit of its own. The apostrophe of short forms stays with its word."""
        usual = [self._usual(t) for t in texts]
        made = pa.array([(t.lower() if u else t).replace("\n", " ") for t, u in zip(texts, usual)], pa.large_string())
        return pc.if_else(pa.array(usual, pa.bool_()), pc.replace_substring_regex(made, EDGE, r"\1 \2"), made)

    def _usual(self, text: str) -> bool:
        try:
            text.isascii() or text.encode("latin-1")  # much faster than the search
        except UnicodeEncodeError:
            return not self.unusual.search(text)
        return "<|" not in text

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.known) + len(words) > self.room:
            self._forget(words)
        known = self.known
        numbers = np.array([known.get(w, -1) for w in words], np.int64)
        self.again[numbers[numbers >= 0]] = True
        places = np.flatnonzero(numbers < 0)
        if len(places):
            missing = [words[i] for i in places.tolist()]
            whole = {chr(c) for c in self.letters}
            simple, others = [], []
            for w in missing:
                (simple if whole.issuperset(w) else others).append(w)
            for at in range(0, len(simple), 4096):
                self._add_simple(simple[at : at + 4096])
            for at in range(0, len(others), 1024):
                part = others[at : at + 1024]
                self._add(part, [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)])
            numbers[places] = [known[w] for w in missing]
        return numbers

    def _add_simple(self, words: list[str]) -> None:
        """Words of whole letters alone go to the model many at once; the suffix of its last unit ends each."""
        text = " ".join(words)
        if not text.isascii():
            text = text.translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last.take(ids)) + 1
        if len(ends) == len(words) and ends[-1] == len(ids):
            self._put(words, ids, np.diff(ends, prepend=0))
        else:  # the model has no unit for the end of some word
            self._add(words, [[t.id for t in self.tokenizer.model.tokenize(w.translate(self.letters))] for w in words])

    def _forget(self, words: list[str]) -> None:
        """Start anew with the words met again since the last time, or with those of ``words`` if these are too many."""
        kept = [w for w, again in zip(self.known, self.again.tolist()) if w and again]
        if len(kept) > self.room // 2:
            kept = [w for w in words if w and w in self.known]
        at = np.array([self.known[w] for w in kept], np.int64)
        flat, start, lengths = self.flat, self.start[at], self.length[at]
        self._empty()
        ends = np.cumsum(lengths)
        self._put(kept, flat[np.repeat(start - (ends - lengths), lengths) + np.arange(int(lengths.sum()))], lengths)

    def _add(self, words: list[str], found: list[list[int]]) -> None:
        self._put(words, np.array([i for ids in found for i in ids], np.uint32), np.fromiter(map(len, found), np.int64, len(found)))

    def _put(self, words: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        first = len(self.known)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while first + len(words) > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[first : first + len(words)] = lengths
        self.start[first : first + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.known.update(zip(words, range(first, first + len(words))))


def task_encoder(file: str) -> TextEncoder:
    """The encoder of this worker process: the words of earlier tasks are still known."""
    held = sys.modules.setdefault("_tidegate_encoders", types.ModuleType("_tidegate_encoders")).__dict__
    if file not in held:
        held[file] = TextEncoder(file)
    return held[file]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each text's ids."""
    return np.insert(ids, np.cumsum(counts), end_id).astype("<u4"), counts + 1


def binary_pieces(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive runs of ids as little-endian bytes, without a copy per run."""
    offsets = np.concatenate([[0], ends]).astype(np.int64) * 4
    return pa.Array.from_buffers(
        pa.large_binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())]
    ).cast(pa.binary())
