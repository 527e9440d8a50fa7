"""Exact token counts of every prefix of a text under a byte-level BPE tokenizer.

For each pre-token a dynamic program runs over its bytes. The last token of the encoding
of w[:i] is the one token t ending at i that either is the whole prefix or may follow the
last token of w[:i - len(t)]; two tokens may stand side by side when their joined bytes
encode to just those two. The count of a prefix is then one more than that of the prefix
before its last token. Stored counts answer totals, truncation and budget questions
without encoding again; the tokenizer file alone gives the vocabulary and the merges.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from tokenizers import pre_tokenizers

from flightlens.llm.common import text_slices

LIMIT = 512
#: White space as the tokenizers library has it (the Unicode property White_Space).
_WS = r"\t-\r \x85\xa0  -     　"
#: The byte-level pre-tokenizer's pattern; a fixed value.
_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
#: Ranges in which all versions of Unicode of the last ten years agree on letters and digits.
_SETTLED = r"\x00-\u024f\u0391-\u03a1\u03a3-\u03ff\u0400-\u052f\u2000-\u206f\u3040-\u3096\u30a0-\u30ff\u4e00-\u9fa5\uac00-\ud7a3"
_LONG_CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Prefix counts under one tokenizer file; keeps the counts of the pre-tokens it has met."""

    #: Pre-tokens of up to so many characters are remembered, so many of them; so many pairs.
    WORD_CHARS, WORDS, PAIRS = 48, 1_200_000, 600_000

    def __init__(self, data: str) -> None:
        spec = json.loads(data)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")
        letters = _byte_letters()
        raw = {token: bytes(letters[c] for c in token) for token in model["vocab"] if all(c in letters for c in token)}
        self.tokens = frozenset(raw.values())
        self.longest = max(map(len, self.tokens))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(raw[a], raw[b]): i for i, (a, b) in enumerate(merges)}
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.split = regex.compile(_PATTERN)
        self.space, self.run = regex.compile(f"[{_WS}]+"), regex.compile(f"[{_WS}]{{2}}")
        self.settled = regex.compile(f"[^{_SETTLED}]")
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding of a short byte string by merging the best-ranked pair until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank, none = self.rank, len(self.rank)
        ranks = [rank.get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), none)
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), none)
        return parts

    def _stands(self, key: tuple[bytes, bytes]) -> bool:
        """Whether the second token may follow the first; the first empty: may stand first."""
        found = self.merged(key[0] + key[1]) == [x for x in key if x]
        if len(self.pairs) > self.PAIRS:
            self.pairs.clear()
        self.pairs[key] = found
        return found

    def _program(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        size = len(data)
        last, count = [b""], [0]
        tokens, pairs = self.tokens, self.pairs
        for i in range(1, size + 1):
            for j in range(max(0, i - self.longest), i):
                token = data[j:i]
                if token in tokens:
                    key = (last[j], token)
                    stands = pairs.get(key)
                    if stands if stands is not None else self._stands(key):
                        last.append(token)
                        count.append(count[j] + 1)
                        break
        if size == len(word):
            return count[1:]
        return [count[i] for i in range(1, size + 1) if i == size or data[i] & 0xC0 != 0x80]

    def word(self, word: str) -> bytes | np.ndarray:
        """Counts of all prefixes of one pre-token, by characters; short ones as one byte each."""
        found = self.words.get(word)
        if found is not None:
            return found
        counts = self._program(word)
        if word in _LONG_CONTRACTIONS:  # cut after one letter, it is a mark and a letter
            counts = [1, 2, counts[2]]
        if len(word) > self.WORD_CHARS:
            return np.array(counts, np.int64)
        if len(self.words) > self.WORDS:
            self.words.clear()
        self.words[word] = found = bytes(counts)  # a character has 4 bytes at most, so counts stay below 256
        return found

    def _segment(self, text: str) -> np.ndarray:
        if self.settled.search(text):  # letters that Unicode versions may class otherwise: as the library has them
            words = [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        else:
            words = self.split.findall(text)
        if not words:
            return np.zeros(0, np.int64)
        known = self.words
        counts = [c if (c := known.get(w)) is not None else self.word(w) for w in words]
        sizes = np.fromiter(map(len, counts), np.int64, len(counts))
        ends = np.cumsum(sizes)
        if max(sizes) > self.WORD_CHARS:
            inside = np.concatenate([np.frombuffer(c, np.uint8) if isinstance(c, bytes) else c for c in counts]).astype(np.int64)
        else:
            inside = np.frombuffer(b"".join(counts), np.uint8).astype(np.int64)
        totals = inside[ends - 1]
        base = np.cumsum(totals) - totals
        found = inside + np.repeat(base, sizes)
        if self.run.search(text):
            for j, (w, after) in enumerate(zip(words, words[1:], strict=False)):
                # Cut just behind white space, the whole run is one pre-token.
                if self.space.fullmatch(w) and self.space.match(after):
                    found[ends[j]] = base[j] + self.word(w + after[0])[-1]
        return found

    def prefix_counts(self, text: str | None) -> np.ndarray:
        """Tokens of text[:1], text[:2], ... text; a special token inside the text is one token."""
        if not text:
            return np.zeros(0, np.int64)
        if self.special is None or not self.special.search(text):
            return self._segment(text)
        parts, done, before = [], 0, ""
        for k, piece in enumerate(self.special.split(text)):
            if k % 2 == 0:
                own, before = self._segment(piece), piece
            else:  # short of its last character a special token is ordinary text
                own = np.array([self._segment(before + piece[:i])[-1] - (self._segment(before)[-1] if before else 0) for i in range(1, len(piece))] + [1])
            parts.append(own + done)
            done = int(parts[-1][-1]) if len(own) else done
        return np.concatenate(parts)


def longest_prefix(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens (counts may fall again)."""
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


@lru_cache(maxsize=2)
def counter(data: str) -> PrefixCounter:
    """One counter for a tokenizer file and worker."""
    return PrefixCounter(data)


def prefix_table(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, counts (array<int>): element p is the token count of the first p characters.

    `tokenizer` is the content of a tokenizers .json file. Null and empty texts have no
    elements. Whole texts of any length are counted; repeated rows are each counted; an
    empty table gives no rows. Other columns are not read, so their names can't clash.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(tokenizer)
        for batch in chain.from_iterable(map(text_slices, batches)):
            counts = [own.prefix_counts(t).astype(np.int32) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "counts": counts})

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInPandas(run, "doc_id long, counts array<int>")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit, fit_chars.

    All come from the prefix counts: the total is that of the whole text, fit_chars the
    longest prefix within `limit` tokens. Nulls, repeats and empty tables are treated as
    prefix_table says; the counts themselves stay in the task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(tokenizer)
        for batch in chain.from_iterable(map(text_slices, batches)):
            rows = []
            for text in batch["text"]:
                counts = own.prefix_counts(text)
                total = int(counts[-1]) if len(counts) else 0
                rows.append((len((text or "").encode("utf-8", "surrogatepass")), total, total > limit, longest_prefix(counts, limit) if total > limit else len(counts)))
            out = pd.DataFrame(rows, columns=["n_bytes", "n_tokens", "over_limit", "fit_chars"])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").to_numpy())
            yield out

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInPandas(run, schema)
