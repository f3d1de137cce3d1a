"""Token counts by rank-synchronous array merging.

Pre-tokens that a task has not met before are held together as one ragged numpy
array of symbols. In each round every sequence merges its pair of lowest rank,
all at once; a sequence without a known pair is finished, and its surviving
symbols are its token count. A text's count is the sum over its blank-separated
chunks, whose counts are remembered within bounds.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import table

MAX_TOKENS = 2048
#: Chunks that a task remembers, and their longest length.
REMEMBER, REMEMBER_CHARS = 400_000, 64
_NONE = np.iinfo(np.int64).max
# First and last of code points that the tokenizer's library does not take for letters, though later versions of Unicode do.
NO_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7),
    (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF3),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE),
    (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
    (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


def _blanks(pattern: str) -> str:
    """Unicode white space without U+001C-U+001F, which \\s of the regex module adds."""
    return pattern.replace("\\s", " \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000")


LOWER = str.maketrans({"\u03a3": "\u03c3", "\ua7cb": "\u0264", "\ua7dc": "\u019b"})


class MergeTable:
    """Ranks and results of the merges of a ``tokenizers`` file with byte-level BPE and a word-end suffix."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in spec["added_tokens"]]
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.inner = np.array([vocab[letter[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letter[b] + end] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.base = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(_blanks(split))
        odd = "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in NO_LETTERS)
        self.odd = regex.compile(f"[{odd}]")
        letters, others = "[\\p{L}]+", "[^\\s\\p{L}\\p{N}]+"
        if letters not in split or others not in split:
            raise ValueError(f"unknown pattern {split}")
        self.odd_pattern = regex.compile(_blanks(split.replace(others, f"(?:[{odd}]|{others[:-1]})+").replace(letters, f"(?:(?![{odd}])\\p{{L}})+")))
        self.blank = regex.compile("[ \\t-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
        self.specials = regex.compile("|".join(map(regex.escape, self.special)) or "(?!)")

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        raw = [w.encode() for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        out = size.copy()
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.inner[data]
        ends = np.cumsum(size) - 1
        symbol[ends[size > 0]] = self.last[data[ends[size > 0]]]
        seq = np.repeat(np.arange(len(raw)), size)
        while len(symbol) > 1:
            key = symbol[:-1] * self.base + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where((self.keys[at] == key) & (seq[1:] == seq[:-1]), self.ranks[at], _NONE)
            head = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            least = np.minimum.reduceat(np.append(rank, _NONE), head)
            live = least != _NONE
            if not live.any():
                break
            size = np.diff(np.append(head, len(symbol)))
            hit = (rank == np.repeat(least, size)[:-1]) & (rank != _NONE)
            # of overlapping equal pairs every second one, from the left
            where = np.flatnonzero(hit)
            run = np.concatenate([[True], np.diff(where) > 1])
            start = where[np.flatnonzero(run)[np.cumsum(run) - 1]]
            where = where[(where - start) % 2 == 0]
            symbol[where] = self.made[at[where]]
            keep = np.repeat(live, size)  # finished sequences go
            keep[where + 1] = False
            np.subtract.at(out, seq[where], 1)
            symbol, seq = symbol[keep], seq[keep]
        return out

    def pre_tokens(self, chunk: str) -> tuple[list[str], int]:
        """Pre-tokens of a chunk without blanks, and the special strings in it."""
        parts = self.specials.split(chunk) if "<" in chunk else [chunk]
        words = []
        for p in parts:
            # each character is lower-cased by itself, so a final sigma is like any other; two are younger than Python's tables
            pattern = self.pattern if p.isascii() or not self.odd.search(p) else self.odd_pattern
            words += pattern.findall(unicodedata.normalize("NFC", p).translate(LOWER).lower())
        return words, len(parts) - 1


class Counter:
    """Counts tokens of texts; remembers a bounded number of chunks."""

    def __init__(self, merges: MergeTable):
        self.merges, self.known = merges, {}

    def _learn(self, chunks: list[str]) -> dict[str, int]:
        spans, words, extra = [], [], []
        for c in chunks:
            w, e = self.merges.pre_tokens(c)
            spans.append(len(w))
            words += w
            extra.append(e)
        different = list(dict.fromkeys(words))
        n = dict(zip(different, self.merges.count(different).tolist(), strict=True)) if different else {}
        each, i, out = [n[w] for w in words], 0, {}
        for c, k, e in zip(chunks, spans, extra, strict=True):
            out[c] = sum(each[i : i + k]) + e
            i += k
        return out

    def chunks(self, text: str) -> list[str]:
        # str.split also cuts at U+001C-U+001F, which are no white space here
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [c for c in self.merges.blank.split(text) if c]
        return text.split()

    def count(self, texts: list[str | None]) -> list[int]:
        out = []
        for at in range(0, len(texts), 256):
            split = [self.chunks(t or "") for t in texts[at : at + 256]]
            if len(self.known) > REMEMBER:
                self.known = {}
            new = set()
            for c in split:
                new.update(set(c).difference(self.known))
            long = {c for c in new if len(c) > REMEMBER_CHARS}
            self.known.update(self._learn(sorted(new - long)))
            here = self.known | self._learn(sorted(long)) if long else self.known
            out += [sum(map(here.__getitem__, c)) for c in split]
        return out


def count_tokens(docs: DataFrame, path: str, limit: int = MAX_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each row of ``docs``; ``path``: the tokenizer's file.

    Null texts count as empty: no bytes, no tokens. Repeated rows and null ids
    give a row each; extra columns are ignored.
    """
    spec = MergeTable(path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(spec)
        for b in batches:
            n = []
            for i in range(0, len(b), 256):
                n += counter.count(b["text"].slice(i, 256).to_pylist())
            n = np.array(n, np.int64)
            yield pa.record_batch([b["doc_id"], b["n_bytes"], pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str, name: str = "word_bpe_49k.json") -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(name))
