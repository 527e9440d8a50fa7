"""SentencePiece models run by the tokenizers library.

The model file is parsed from its protobuf; the normaliser, the white-space marker, the
scores and the byte fallback are rebuilt as a tokenizers pipeline, which encodes and
decodes whole batches on several threads. Parity with the sentencepiece library is
checked for everything that is encoded, and a difference is reported, not hidden.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from flightlens.llm.common import release_memory, text_slices

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Threads of a batch call in one worker.
THREADS = 2


@dataclass
class ModelSpec:
    """What a SentencePiece model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        else:
            if wire == 2:
                size, at = _varint(data, at)
            elif wire in (1, 5):
                size = 8 if wire == 1 else 4
            else:
                raise ValueError(f"wire type {wire} in a model file")
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def parse_model(data: bytes) -> ModelSpec:
    """The pieces, trainer and normaliser settings of a model file."""
    spec = ModelSpec()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            spec.pieces.append((own[1].decode(), struct.unpack("<f", own.get(2, bytes(4)))[0], own.get(3, NORMAL)))
        elif number == 2:
            own = dict(_fields(value))
            spec.model_type, spec.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
        elif number == 3:
            own = dict(_fields(value))
            spec.charsmap = own.get(2, b"")
            spec.dummy_prefix, spec.trim_spaces, spec.escape_spaces = (bool(own.get(k, 1)) for k in (3, 4, 5))
    if spec.model_type not in (UNIGRAM, BPE):
        raise ValueError(f"model type {spec.model_type} is neither unigram nor BPE")
    return spec


def _merges(spec: ModelSpec) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best-scored piece first."""
    rank = {p: i for i, (p, _, kind) in enumerate(spec.pieces) if kind == NORMAL}
    found = []
    for piece, score, kind in spec.pieces:
        if kind == NORMAL:
            cuts = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in rank and piece[i:] in rank]
            found += [(-score, rank[a], rank[b], a, b) for a, b in cuts]
    return [(a, b) for *_, a, b in sorted(found)]


def build(spec: ModelSpec) -> Tokenizer:
    """The tokenizers pipeline that encodes and decodes as the model says."""
    names = [p for p, _, _ in spec.pieces]
    unknown = next(i for i, (_, _, kind) in enumerate(spec.pieces) if kind == UNKNOWN)
    if spec.model_type == BPE:
        model = models.BPE(
            {p: i for i, p in enumerate(names)}, _merges(spec), unk_token=names[unknown], fuse_unk=True, byte_fallback=spec.byte_fallback
        )
    else:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unk_id=unknown, byte_fallback=spec.byte_fallback)
    built = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.trim_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if spec.escape_spaces else " "))
    if spec.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    built.normalizer = normalizers.Sequence(steps)
    if not any(MARK in p.lstrip(MARK) for p in names):
        # No piece goes on over a marker, so words are encoded apart, and cached.
        built.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    end = [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []
    built.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *end])
    own = [AddedToken(p, normalized=False) for p, _, kind in spec.pieces if kind == USER_DEFINED]
    if own:
        built.add_tokens(own)
    return built


class Coder:
    """A model's tokenizers pipeline, applied to the distinct pieces of text between spaces.

    Where no piece of the vocabulary goes on over a space, what stands between two spaces
    is encoded alike wherever it stands. Each distinct one of a batch is encoded once, in one
    multithreaded call, and a text's ids are those of its parts. Other models encode whole
    texts. Parity and round trip are measured on every whole text: its ids are compared with
    the sentencepiece library's ids of the text, and that library decodes them to the text; the
    pipeline's own decoder is tested on every distinct part, and on their joins.
    """

    #: Parts of up to so many characters are remembered, so many of them in a task, and
    #: so many between tasks, when other work needs the memory: those of few characters, which recur most.
    PART_CHARS, PARTS, KEPT_PARTS = 48, 500_000, 120_000
    #: Parts handed to the libraries in one multithreaded call, and joined to one text in it.
    CALL_PARTS, JOINED_PARTS = 16_384, 2_048
    #: Characters of whole texts that are measured in one call; a longer text is a call of its own.
    CALL_CHARS = 500_000

    def __init__(self, data: bytes) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))  # read at the library's first batch
        self.spec = parse_model(data)
        self.fast = build(self.spec)
        self.known = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.byte_ids = np.array([kind == BYTE for _, _, kind in self.spec.pieces])
        names = [p for p, _, _ in self.spec.pieces]
        self.leading = np.array([p.startswith(MARK) for p in names])
        plain = self.spec.dummy_prefix and self.spec.escape_spaces and not self.spec.trim_spaces and not self.spec.charsmap
        self.by_parts = plain and MARK in names and not any(MARK in p.lstrip(MARK) or kind == USER_DEFINED for p, _, kind in self.spec.pieces)
        self.seen: dict[str, bytes] = {}
        #: Parts that the pipeline doesn't decode to themselves.
        self.changed: set[str] = set()

    def parts(self, text: str) -> list[str]:
        """The text between spaces; of several spaces all but one go with what follows."""
        if not text or not self.by_parts:
            return [text] if text else []
        text = text.replace(MARK, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [x[1:] for x in re.findall(" *[^ ]+| +$", " " + text)]
        return text.split(" ")

    def _learn(self, parts: list[str]) -> None:
        """Remembers the ids of parts, as little-endian 32-bit numbers.

        Parts without spaces are encoded many at a time as one text with spaces between: each
        begins at a piece with a marker. Where that doesn't come out, or they don't decode to
        the text, they are taken one by one.
        """
        whole = [p for p in parts if self.by_parts and p and " " not in p]
        single = [p for p in parts if not self.by_parts or not p or " " in p]
        for start in range(0, len(whole), self.CALL_PARTS):
            end = min(start + self.CALL_PARTS, len(whole))
            groups = [whole[i : min(i + self.JOINED_PARTS, end)] for i in range(start, end, self.JOINED_PARTS)]
            joined = [" ".join(g) for g in groups]
            found = [e.ids for e in self.fast.encode_batch_fast(joined, add_special_tokens=False)]
            back = self.fast.decode_batch(found, skip_special_tokens=False)
            for group, ids, same in zip(groups, found, map(str.__eq__, joined, back), strict=True):
                flat = np.array(ids, "<i4")
                at = np.flatnonzero(self.leading[flat])
                if same and len(at) == len(group) and at[0] == 0:
                    data, cuts = flat.tobytes(), (4 * at).tolist()
                    self.seen.update(zip(group, [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)], strict=True)], strict=True))
                else:
                    single += group
        for start in range(0, len(single), self.CALL_PARTS):
            some = single[start : start + self.CALL_PARTS]
            found = [e.ids for e in self.fast.encode_batch_fast(some, add_special_tokens=False)]
            self.seen.update(zip(some, [struct.pack(f"<{len(i)}i", *i) for i in found], strict=True))
            self.changed.update(p for p, t in zip(some, self.fast.decode_batch(found, skip_special_tokens=False), strict=True) if p != t)

    def encode(self, texts: list[str]) -> list[tuple[bytes, bool, bool]]:
        """(ids, parity, round trip) of each text."""
        split = [self.parts(t) for t in texts]
        if len(self.seen) > self.PARTS:
            self.trim()
        seen = self.seen
        if self.by_parts and "" not in seen:  # a space at the end of a text, alone
            seen[""] = struct.pack("<i", self.fast.token_to_id(MARK))
        new = list({p for parts in split for p in parts if p not in seen})
        self._learn(new)
        ids = [b"".join([seen[p] for p in parts]) for parts in split]
        kept = [not self.changed or self.changed.isdisjoint(parts) for parts in split]
        for p in new:
            if len(p) > self.PART_CHARS:
                del seen[p]
        del split, new
        return self._measured(texts, ids, kept)

    def _measured(self, texts: list[str], ids: list[bytes], kept: list[bool]) -> list[tuple[bytes, bool, bool]]:
        """The ids with what the libraries say of each whole text, a few texts at a time."""
        done: list[tuple[bytes, bool, bool]] = []
        ends = np.cumsum([len(t) for t in texts]) // self.CALL_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = [np.frombuffer(i, "<i4") for i in ids[a:b]]
            others = self.known.encode(texts[a:b], num_threads=THREADS)
            same = [len(x) == len(y) and bool((x == np.array(y, "<i4")).all()) for x, y in zip(own, others, strict=True)]
            del others
            back = self.known.decode([x.tolist() for x in own], num_threads=THREADS)
            done += [(i, p, k and t == d) for i, p, k, t, d in zip(ids[a:b], same, kept[a:b], texts[a:b], back, strict=True)]
        return done

    def trim(self, keep: int = PARTS // 2) -> None:
        """Forgets all but at most `keep` parts, the longest first."""
        if len(self.seen) <= keep:
            return
        sizes = np.bincount([len(p) for p in self.seen])
        most = int(np.searchsorted(np.cumsum(sizes), keep, "right")) - 1  # characters
        self.seen = {p: c for p, c in self.seen.items() if len(p) <= most}
        self.changed.intersection_update(self.seen)


@lru_cache(maxsize=2)
def coder(data: bytes) -> Coder:
    """One coder for a model and worker."""
    return Coder(data)


def _encoded(batches: Iterator[pd.DataFrame], model: bytes) -> Iterator[tuple[pd.Series, list[tuple[bytes, bool, bool]]]]:
    own = coder(model)
    for batch in batches:
        for part in text_slices(batch):
            yield part["doc_id"].astype("Int64"), own.encode([t or "" for t in part["text"]])
    own.trim(own.KEPT_PARTS)
    release_memory()


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array<int>), parity.

    Whole texts are encoded, without begin or end tokens; control pieces inside a text are
    ordinary text. Null and empty texts have no ids. parity: the ids equal those of the
    sentencepiece library for the whole text. Repeated rows are each encoded; an empty table gives no rows.
    Other columns are not read, so their names can't clash. `model` is the content of the
    model file, so workers need no file of their own.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, coded in _encoded(batches, model):
            yield pd.DataFrame({"doc_id": ids.to_numpy(), "ids": [np.frombuffer(c[0], "<i4") for c in coded], "parity": [c[1] for c in coded]})

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInPandas(run, "doc_id long, ids array<int>, parity boolean")


def _id_slices(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in parts of about a million ids each; a longer list is a part of its own."""
    held = np.cumsum([0 if i is None else len(i) for i in batch["ids"]]) // 1_000_000
    cuts = [0, *(np.flatnonzero(np.diff(held)) + 1), len(batch)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.iloc[a:b]


def decode(encoded: DataFrame, model: bytes) -> DataFrame:
    """One row per input row (doc_id, ids): doc_id, text. Null ids decode to null, no ids to an empty text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fast = coder(model).fast
        for batch in chain.from_iterable(map(_id_slices, batches)):
            texts = fast.decode_batch([[] if i is None else list(i) for i in batch["ids"]], skip_special_tokens=False)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": [None if i is None else t for i, t in zip(batch["ids"], texts, strict=True)]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, text string")


def digest(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass; per row doc_id, n_tokens, n_byte_tokens, ids_sha256, round_trip, parity.

    ids_sha256 is over the ids as little-endian 32-bit numbers. round_trip: the decoded
    text is the text (a marker character in the text itself decodes to a space). Nulls,
    repeats and empty tables are treated as encode says.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        is_byte = coder(model).byte_ids
        for ids, coded in _encoded(batches, model):
            yield pd.DataFrame(
                {
                    "doc_id": ids.to_numpy(),
                    "n_tokens": [len(c[0]) // 4 for c in coded],
                    "n_byte_tokens": [int(is_byte[np.frombuffer(c[0], "<i4")].sum()) for c in coded],
                    "ids_sha256": [hashlib.sha256(c[0]).hexdigest() for c in coded],
                    "round_trip": [c[2] for c in coded],
                    "parity": [c[1] for c in coded],
                }
            )

    schema = "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean, parity boolean"
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInPandas(run, schema)
