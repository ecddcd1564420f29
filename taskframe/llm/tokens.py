"""Exact token ids of whole texts, by the tokenizers library with a word cache.

Encoding is by far the slowest step of every token operator, and words repeat. Both public tokenizer families split a
text at white space before merging, so a text's ids are its words' ids in order. Words are found with Arrow, each
distinct word of a batch is encoded once by the library, and a bounded cache keeps words between batches. A text whose
white space could make that split wrong (runs, tabs, leading or trailing space) goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most words a worker's cache holds before it is emptied (about 200 bytes each).
CACHE_WORDS = 900_000
#: Bytes of text that are encoded at once.
BATCH_BYTES = 8 << 20

# a worker has one core; the library's own threads would only wait for each other
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_ENCODERS: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The worker's own encoder for a tokenizer file, made once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _kind(spec: dict) -> str:
    """'words': white space is dropped. 'bytes': a space belongs to the word after it. 'whole': neither is certain."""
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") or " " in t["content"] for t in spec.get("added_tokens", [])):
        return "whole"
    if spec.get("post_processor") and spec["post_processor"].get("type") != "ByteLevel":
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "bytes"
    parts = pre.get("pretokenizers", [])
    if pre.get("type") == "Sequence" and parts and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and "[^\\s\\p{L}\\p{N}]" in parts[0]["pattern"].get("Regex", ""):
        if all(n.get("type") in ("NFC", "Replace", "Lowercase") for n in (norm or {}).get("normalizers", [])):
            return "words"
    return "whole"


#: Letters that lower-case and normalise one by one, alike everywhere.
_PLAIN_CLASS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
_PLAIN = re.compile(f"{_PLAIN_CLASS}+")
#: White space of any kind at an end of a word, or no word.
_ODD = r"^$|^[\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}]$"


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            self.kind = _kind(json.load(f))
        self.library = Tokenizer.from_file(path)
        mark = (lambda t: t.endswith("</w>")) if self.kind == "words" else (lambda t: t.startswith("\u0120"))
        vocabulary = self.library.get_vocab(True)
        self.marked = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word, or begin " word"
        self.marked[[i for t, i in vocabulary.items() if mark(t)]] = True
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # ends[i + 1] is where word i's ids end
        self.hits = np.zeros(1 << 14, np.int32)
        self.n = 0
        ids, ends = self._whole(["", ".", ","])
        self._put(["", ".", ","], ids, np.diff(ends))

    def _shrink(self) -> None:
        """Keeps the words met in more than one batch, or none if those alone fill half of the cache."""
        keep = 3 + np.flatnonzero(self.hits[3 : self.n] > 1)
        words, flat, ends, hits = list(self.known), self.flat, self.ends, self.hits
        self._clear()
        if len(keep) <= CACHE_WORDS // 2:
            lens = ends[keep + 1] - ends[keep]
            self._put([words[i] for i in keep], _ragged(flat, ends[keep], lens), lens)
            self.hits[3 : self.n] = hits[keep] // 2

    def _put(self, words: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        end = self.ends[self.n]
        while len(self.ends) < self.n + len(words) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.hits = np.concatenate([self.hits, np.zeros_like(self.hits)])
        while len(self.flat) < end + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.ends[self.n + 1 : self.n + 1 + len(words)] = end + np.cumsum(lens)
        self.flat[end : end + len(ids)] = ids
        self.known.update(zip(words, range(self.n, self.n + len(words))))
        self.n += len(words)

    def _add(self, words: list[str]) -> None:
        """Encodes new words. Plain ones go to the library many in a text, and are told apart by the marked ids."""
        words_kind = self.kind == "words"
        plain, others = [], []
        for w in words:
            (plain if (_PLAIN.fullmatch(w) if words_kind else w[:1] == " " and _PLAIN.fullmatch(w, 1)) else others).append(w)
        for at in range(0, len(plain), 10_000):
            part = plain[at : at + 10_000]
            texts = [(" " if words_kind else "").join(part[i : i + 500]) for i in range(0, len(part), 500)]
            ids, _ = self._whole(texts)
            marks = np.flatnonzero(self.marked[ids])
            if len(marks) != len(part):
                others += part
                continue
            ends = marks + 1 if words_kind else np.append(marks[1:], len(ids))
            self._put(part, ids, np.diff(ends, prepend=0))
        for at in range(0, len(others), 10_000):
            part = others[at : at + 10_000]
            ids, ends = self._whole(part)
            self._put(part, ids, np.diff(ends))

    def _places(self, words: list[str]) -> np.ndarray:
        """Each word's number in the cache; the words are different."""
        if self.n + len(words) > CACHE_WORDS:
            self._shrink()
        found = list(map(self.known.get, words))
        place = np.array(found, np.float64)  # None becomes NaN
        new = np.flatnonzero(np.isnan(place))
        if len(new):
            missing = [words[i] for i in new.tolist()]
            self._add(missing)
            place[new] = list(map(self.known.__getitem__, missing))
        place = place.astype(np.int64)
        self.hits[place] += 1
        return place

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all the words, offsets). A full stop or comma after a plain word is a word of its own."""
        comma = pc.ends_with(words, ",")
        marked = pc.or_(comma, pc.ends_with(words, "."))
        base = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words)
        plain = pc.match_substring_regex(base, f"^ ?{_PLAIN_CLASS}+$")
        marked = pc.and_(marked, plain)
        base = pc.if_else(plain, pc.utf8_lower(base) if self.kind == "words" else base, words)
        coded = base.dictionary_encode()
        place = self._places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[np.asarray(coded.indices)]
        mark = np.asarray(marked, np.int64) + np.asarray(pc.and_(marked, comma), np.int64)
        place = np.stack([place, mark], 1).ravel()  # "", "." and "," are the first words of the cache
        lens = self.ends[place + 1] - self.ends[place]
        return _ragged(self.flat, self.ends[place], lens), np.concatenate([[0], np.cumsum(lens.reshape(-1, 2).sum(1))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ends: n + 1 offsets). Null counts as empty."""
        texts = pc.fill_null(texts, "").combine_chunks() if isinstance(texts, pa.ChunkedArray) else pc.fill_null(texts, "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if self.kind == "whole":
            return self._whole(texts.to_pylist())
        parts, at = [], 0
        size = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_BYTES, "right")))
            parts.append(self._split(texts.slice(at, to - at)))
            at = to
        ends = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.concatenate([p[1] for p in parts]), out=ends[1:])
        return np.concatenate([p[0] for p in parts]), ends

    def counts(self, texts: pa.Array) -> np.ndarray:
        return np.diff(self.encode(texts)[1])

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        ends = np.zeros(len(got) + 1, np.int64)
        np.cumsum([len(g) for g in got], out=ends[1:])
        return np.fromiter(chain.from_iterable(got), np.uint32, int(ends[-1])), ends

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids by text)"""
        bytes_kind = self.kind == "bytes"
        lines = pc.split_pattern(texts, "\n")
        line_of = np.asarray(lines.offsets, np.int64) - lines.offsets[0].as_py()
        words = pc.split_pattern(lines.flatten(), " ")
        word_of_line = np.asarray(words.offsets, np.int64) - words.offsets[0].as_py()
        word_of = word_of_line[line_of]  # where each text's words begin
        coded = words.flatten().dictionary_encode()
        which, distinct = np.asarray(coded.indices, np.int64), coded.dictionary
        if not bytes_kind:
            return self._gather(*self._distinct(distinct), which, word_of, None)
        # " word" and "word" are different words; the first of a line has no space before it
        first = np.zeros(len(which), bool)
        first[word_of_line[:-1]] = True
        odd = np.asarray(pc.match_substring_regex(distinct, _ODD), bool)
        odd_text = np.add.reduceat(odd[which].astype(np.int64), word_of[:-1]) > 0
        seen = np.zeros(2 * len(distinct), bool)
        seen[which * 2 + first] = True
        used = np.flatnonzero(seen)
        rank = np.cumsum(seen) - 1
        which = rank[which * 2 + first]
        variants = distinct.take(pa.array(used >> 1))
        variants = pc.if_else(pa.array(used & 1 == 1), variants, pc.binary_join_element_wise(" ", variants, ""))
        flat, ends = self._distinct(pa.concat_arrays([variants, pa.array(["\n"])]))
        # one token between two lines
        inner = np.setdiff1d(word_of_line[:-1], word_of[:-1])
        which = np.insert(which, inner, len(used))
        word_of = word_of + np.searchsorted(inner, word_of, "left")
        ids, lens = self._gather(flat, ends, which, word_of, odd_text)
        if odd_text.any():
            at = np.flatnonzero(odd_text)
            flat, ends = self._whole(texts.take(pa.array(at)).to_pylist())
            new = lens.copy()
            new[at] = np.diff(ends)
            start = np.concatenate([[0], np.cumsum(lens)])
            pieces, k = [], 0
            for a, b, e in zip(at, ends[:-1], ends[1:]):
                pieces += [ids[start[k] : start[a]], flat[b:e]]
                k = a + 1
            ids, lens = np.concatenate([*pieces, ids[start[k] :]]), new
        return ids, lens

    @staticmethod
    def _gather(flat: np.ndarray, ends: np.ndarray, which: np.ndarray, word_of: np.ndarray, skip: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(ends)[which]
        if skip is not None:
            n[np.repeat(skip, np.diff(word_of))] = 0
        total = np.concatenate([[0], np.cumsum(n)])
        return _ragged(flat, ends[which], n), total[word_of[1:]] - total[word_of[:-1]]


def _ragged(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[s : s + n] of all starts and lengths, one after the other."""
    total = np.cumsum(lens)
    return flat[np.repeat(starts - total + lens, lens) + np.arange(total[-1] if len(total) else 0)]
