"""Phrase collocations by Rabin-Karp fingerprints.

Numpy prefix polynomials over the bytes of a text give the fingerprint of any of its word
n-grams in constant time. An n-gram is no more frequent than its parts, so fingerprints of words
are counted by a first shuffle, those of pairs of frequent words by a second, and those of triples
and quadruples of frequent pairs by a third. What is frequent reaches the next scan as a bitmap of
fixed size (2 ** BITMAP_LOG2 bits, whatever the corpus); a bit shared by chance lets an n-gram
through that the count then drops, so a full bitmap costs shuffle but never a result.

The last shuffle aggregates the fingerprints left, each with its count, a pointer to a text in
which it occurs, and the least and greatest of a second, independent fingerprint. Phrases are read
from the texts pointed at. Where the second fingerprints differ, several phrases share a
fingerprint; those are counted again from the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flightlens.llm.common import discard, materialize, mix64, release_memory

MAX_WORDS = 4
MIN_COUNT = 30
TOP = 2000
#: A candidate goes if a longer one that holds it has at least so many hundredths of its count.
COVERED_PERCENT = 80
SCORE_SCALE = 2_000_000
NO_LANG = "und"
BITMAP_LOG2 = 27
#: Bits of a row of the bitmap, as bitmap_construct_agg makes them.
ROW_BITS = 32_768
FINGERPRINT_BITS = 64
SLICE_BYTES = 1 << 20
#: Up to so many pointers, of eight bytes each, are broadcast to the texts; more meet them by shuffle.
BROADCAST_POINTERS = 2_000_000
#: Hash classes within a language that are ranked first, each down to the report's length.
RANK_CLASSES = 256

_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASES = (0xD6E8FEB86659FD93, 0xA5A3564E5A4F2C6B)

PHRASES = "lang string, phrase string, fp long, n long"


class Polynomial:
    """Fingerprints modulo 2 ** 64 of byte ranges: random odd values of bytes, powers of an odd base and their inverses."""

    def __init__(self, base: int) -> None:
        self.base = base
        self.values = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(base)) | np.uint64(1)
        self._extend(1 << 16)

    def _extend(self, size: int) -> None:
        self.powers, self.inverses = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (self.base, pow(self.base, -1, 1 << 64)))

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.powers):
            self._extend(max(len(data), SLICE_BYTES))
        return np.r_[np.uint64(0), np.cumsum(self.values[data] * self.powers[: len(data)])]

    def ranges(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray, seed: np.uint64) -> np.ndarray:
        """Fingerprints of data[start:end], spread over all bits and told apart by seed."""
        return mix64((prefixes[end] - prefixes[start]) * self.inverses[start] + seed)


class Words:
    """The words of one slice of texts of one language, and the fingerprints of their n-grams.

    Words of a piece follow each other with one space between them in data, so an n-gram is a
    range of data whatever blanks the text has.
    """

    def __init__(self, polynomials: tuple[Polynomial, Polynomial], lang: str, texts: list[bytes], owners: np.ndarray, bits: int) -> None:
        raw = np.frombuffer(b"\n".join(texts).translate(_LOWER) + b"\n", np.uint8)
        kind = _KIND[raw]
        inside = kind == 0
        edges = np.flatnonzero(np.diff(inside, prepend=False))
        begin, end = edges[0::2], edges[1::2]
        kept = inside.copy()
        kept[end] = True
        self.data = np.where(inside, raw, 0x20)[kept].astype(np.uint8)
        self.start = np.cumsum(end - begin + 1) - (end - begin + 1)
        self.end = self.start + (end - begin)
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), begin)
        self.owner = owners[np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, "right")]
        self.seeds = np.frombuffer(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.uint64)
        self.polynomials = polynomials
        self.prefixes = [p.prefixes(self.data) for p in polynomials]
        self.drop = np.uint64(64 - bits)

    def starts(self, n: int) -> np.ndarray:
        """First words of the n-grams that lie in one piece."""
        last = len(self.start) - n + 1
        return np.flatnonzero(self.piece[:last] == self.piece[n - 1 :]) if last > 0 else np.zeros(0, np.int64)

    def fingerprints(self, first: np.ndarray, n: int, which: int = 0) -> np.ndarray:
        found = self.polynomials[which].ranges(self.prefixes[which], self.start[first], self.end[first + n - 1], self.seeds[which])
        return found >> self.drop << self.drop if which == 0 else found

    def phrase(self, first: int, n: int) -> str:
        return self.data[self.start[first] : self.end[first + n - 1]].tobytes().decode("utf-8", "surrogatepass")


def in_bitmap(bitmap: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
    bit = fingerprints >> np.uint64(64 - BITMAP_LOG2)
    return (bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts of about SLICE_BYTES, cut where a piece ends; a piece is never cut."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        limit = at + SLICE_BYTES
        cut = max(text.rfind(c, at, limit) for c in (b"\n", b".", b",", b";", b":", b"!", b"?", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:
            found = np.flatnonzero(_KIND[np.frombuffer(text, np.uint8, offset=limit)] == 2)
            if not len(found):
                break
            cut = limit + int(found[0])
        yield text[at : cut + 1]
        at = cut + 1
    yield text[at:]


def _slices(batches: Iterator[pa.RecordBatch], bits: int, *more: str) -> Iterator[tuple]:
    """(lang, words, rows of the columns in more) of texts of one language, about SLICE_BYTES at a time."""
    polynomials = (Polynomial(_BASES[0]), Polynomial(_BASES[1]))
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def take(lang: str) -> tuple:
        rows = held.pop(lang)
        sizes.pop(lang)
        owners = np.array([r[1] for r in rows], np.int64)
        return lang, Words(polynomials, lang, [r[0] for r in rows], owners, bits), rows

    for batch in batches:
        columns = [batch.column(c) for c in ("lang", "text", "ptr", *more)]
        for i in range(batch.num_rows):
            lang, text, ptr, *rest = (c[i].as_py() for c in columns)
            for part in _parts(text.encode("utf-8", "surrogatepass")):
                if sizes.get(lang, 0) + len(part) > SLICE_BYTES and lang in held:
                    yield take(lang)
                held.setdefault(lang, []).append((part, ptr, *rest))
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
        if sum(sizes.values()) > 8 * SLICE_BYTES:  # many languages
            for lang in list(held):
                yield take(lang)
    for lang in list(held):
        yield take(lang)


def _level(words: Words, level: int, bitmap: np.ndarray | None) -> Iterator[tuple[np.ndarray, int]]:
    """(first words, n) of the n-grams of a level whose parts are frequent, as far as the bitmap tells."""
    if level == 1:
        yield words.starts(1), 1
    elif level == 2:
        hot = in_bitmap(bitmap, words.fingerprints(words.starts(1), 1))
        first = words.starts(2)
        yield first[hot[first] & hot[first + 1]], 2
    else:
        pairs = words.starts(2)
        hot = np.zeros(len(words.start) + 3, bool)
        hot[pairs[in_bitmap(bitmap, words.fingerprints(pairs, 2))]] = True
        run = np.flatnonzero(hot[:-1] & hot[1:])
        for n in range(3, MAX_WORDS + 1):
            yield run, n
            run = run[hot[run + n - 1]]


def _heads(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, np.int64)


def count_slices(level: int, bits: int, bitmap=None):
    """mapInArrow's function for one level: counts of a slice's distinct fingerprints; level 1 also gives words by language (fp null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = None if bitmap is None else np.frombuffer(bitmap.value, np.uint8)
        for lang, words, _ in _slices(batches, bits):
            fp = np.sort(np.concatenate([words.fingerprints(first, n) for first, n in _level(words, level, flags)]))
            heads = _heads(fp)
            columns = [pa.array(fp[heads].view(np.int64)), pa.array(np.diff(np.r_[heads, len(fp)]))]
            if level > 1:
                yield pa.RecordBatch.from_arrays(columns, ["fp", "n"])
                continue
            yield pa.RecordBatch.from_arrays([pa.nulls(len(heads), pa.string()), *columns], ["lang", "fp", "n"])
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.nulls(1, pa.int64()), pa.array([len(words.start)])], ["lang", "fp", "n"])
        release_memory()

    return run


def point_slices(bits: int, bitmap):
    """mapInArrow's function for the fingerprints in the bitmap: count, least pointer, least and greatest second fingerprint in a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(bitmap.value, np.uint8)
        for _, words, _ in _slices(batches, bits):
            parts = []
            for n in range(1, MAX_WORDS + 1):
                first = words.starts(n)
                fp = words.fingerprints(first, n)
                hit = in_bitmap(flags, fp)
                parts.append((fp[hit], words.fingerprints(first[hit], n, 1), words.owner[first[hit]]))
            fp, second, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(fp)
            fp, second, owner = fp[order], second[order].view(np.int64), owner[order]
            heads = _heads(fp)
            low, high, ptr = (f.reduceat(x, heads) if len(heads) else np.zeros(0, np.int64) for f, x in ((np.minimum, second), (np.maximum, second), (np.minimum, owner)))
            columns = [fp[heads].view(np.int64), np.diff(np.r_[heads, len(fp)]), ptr, low, high]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["fp", "n", "ptr", "low", "high"])
        release_memory()

    return run


def pointed_phrases(bits: int):
    """mapInArrow's function for the texts that are pointed at: the phrases of the fingerprints that each is to give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        polynomials = (Polynomial(_BASES[0]), Polynomial(_BASES[1]))
        for batch in batches:
            out: list[tuple] = []
            for lang, text, wanted in zip(*(batch.column(c) for c in ("lang", "text", "wanted")), strict=True):
                lang = lang.as_py()
                fps, lows = (wanted.values.field(k).to_numpy().view(np.uint64) for k in ("fp", "low"))
                order = np.argsort(fps)
                fps, lows = fps[order], lows[order]
                for part in _parts(text.as_py().encode("utf-8", "surrogatepass")):
                    words = Words(polynomials, lang, [part], np.zeros(1, np.int64), bits)
                    for n in range(1, MAX_WORDS + 1):
                        first = words.starts(n)
                        fp = words.fingerprints(first, n)
                        at = np.minimum(np.searchsorted(fps, fp), len(fps) - 1)
                        hit = (fps[at] == fp) & (lows[at] == words.fingerprints(first, n, 1))
                        found, where = np.unique(fp[hit], return_index=True)
                        out += [(lang, words.phrase(i, n), f, 0) for f, i in zip(found.view(np.int64).tolist(), first[hit][where].tolist(), strict=True)]
            yield _phrase_batch(out)
        release_memory()

    return run


def texts_of_grams(bits: int):
    """mapInArrow's function for fingerprints that several phrases share: every n-gram of a slice as text, with its count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, _ in _slices(batches, bits):
            for n in range(1, MAX_WORDS + 1):
                first = words.starts(n)
                both, where, counts = np.unique(np.stack([words.fingerprints(first, n), words.fingerprints(first, n, 1)], 1), axis=0, return_index=True, return_counts=True)
                yield _phrase_batch([(lang, words.phrase(i, n), f, c) for f, i, c in zip(both[:, 0].view(np.int64).tolist(), first[where].tolist(), counts.tolist(), strict=True)])

    return run


def _phrase_batch(rows: list[tuple]) -> pa.RecordBatch:
    lang, phrase, fp, n = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrase, pa.string()), pa.array(fp, pa.int64()), pa.array(n, pa.int64())], ["lang", "phrase", "fp", "n"])


def frequent_bitmap(frequent: DataFrame):
    """A broadcast bitmap of the fingerprints' first bits: at most 2 ** BITMAP_LOG2 / 8 bytes, built by aggregation."""
    bit = F.shiftrightunsigned("fp", 64 - BITMAP_LOG2)
    rows = frequent.select((bit / ROW_BITS).cast("int").alias("row"), (bit % ROW_BITS).alias("bit")).groupBy("row").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bitmap = np.zeros(2**BITMAP_LOG2 // 8, np.uint8)
    for row in rows.toLocalIterator():
        at = row["row"] * ROW_BITS // 8
        bitmap[at : at + ROW_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return frequent.sparkSession.sparkContext.broadcast(bitmap.tobytes())


def ngram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, bits: int = FINGERPRINT_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to MAX_WORDS words that occur at least min_count times, and (lang, n) words in all.

    bits < 64 makes fingerprints collide, for tests.
    """
    lang, text = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(lang.alias("lang"), text.alias("text"), F.xxhash64(lang, text).alias("ptr"))
    counted = texts.mapInArrow(count_slices(1, bits), "lang string, fp long, n long").groupBy("lang", "fp").agg(F.sum("n").alias("n"))
    kept = materialize(counted.filter(F.col("fp").isNull() | (F.col("n") >= min_count)))
    totals = materialize(kept.filter(F.col("fp").isNull()).select("lang", "n"))
    levels = [kept.filter(F.col("fp").isNotNull()).select("fp")]
    for level in (2, 3):
        counted = texts.mapInArrow(count_slices(level, bits, frequent_bitmap(levels[-1])), "fp long, n long").groupBy("fp").agg(F.sum("n").alias("n"))
        levels.append(materialize(counted.filter(F.col("n") >= min_count).select("fp")))
    bitmap = frequent_bitmap(levels[0].union(levels[1]).union(levels[2]))
    pointing = texts.mapInArrow(point_slices(bits, bitmap), "fp long, n long, ptr long, low long, high long")
    frequent = pointing.groupBy("fp").agg(F.sum("n").alias("n"), F.min("ptr").alias("ptr"), F.min("low").alias("low"), F.max("high").alias("high"))
    frequent = materialize(frequent.filter(F.col("n") >= min_count))

    # Pointers are least hashes, so few texts are pointed at, each by many phrases. Only those
    # leave the scan, copies once a task.
    whole = frequent.filter(F.col("low") == F.col("high"))
    pointed = materialize(whole.groupBy("ptr").agg(F.collect_list(F.struct("fp", "low")).alias("wanted")))
    pointers = pointed.select("ptr")
    pointers = F.broadcast(pointers) if pointed.count() <= BROADCAST_POINTERS else pointers
    picked = texts.join(pointers, "ptr", "left_semi").dropDuplicates(["ptr", "lang", "text"])
    read = picked.join(pointed, "ptr").select("lang", "text", "wanted").mapInArrow(pointed_phrases(bits), PHRASES)
    named = read.groupBy("fp").agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))
    found = named.join(whole.select("fp", "n"), "fp").select("lang", "phrase", F.col("n").alias("f"))

    shared = frequent.filter(F.col("low") != F.col("high")).select("fp")
    if not shared.isEmpty():
        recount = texts.mapInArrow(texts_of_grams(bits), PHRASES).join(shared, "fp", "left_semi")
        found = found.union(recount.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count))
    found = materialize(found)
    discard(kept, *levels[1:], frequent, pointed)
    return found, totals


def _words(phrase: str) -> Column:
    return F.split(phrase, " ")


def _part(first: Column, length: Column) -> Column:
    return F.array_join(F.slice("words", first, length), " ")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, bits: int = FINGERPRINT_BITS) -> DataFrame:
    """The best collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces at .,;:!? and line ends and those into words at
    spaces and tabs. A phrase of 2 to 4 words that occurs a >= min_count times scores
    floor(2000000 * a / (l + r)) at its lowest-scoring cut (ties: the first), where l and r count
    its two parts. Phrases that longer candidates cover are dropped; those ranked first, by
    score, a and phrase, are returned. A null language is und, a null text empty; repeated rows
    count as often as they stand; an empty table gives no rows. Other columns aren't read, so
    their names can't clash. Texts of any length are read whole, a piece at a time: only a piece
    without any of its ends has to fit a worker's memory.
    """
    found, totals = ngram_counts(docs, text_col, lang_col, min_count, bits)
    candidates = found.withColumn("words", _words("phrase")).withColumn("size", F.size("words")).filter(F.col("size") > 1)

    cuts = candidates.select("lang", "phrase", "words", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _part(F.lit(1), F.col("cut")).alias("left"), _part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"))
    lefts, rights = (found.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)) for side, count in (("left", "l"), ("right", "r")))
    scored = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    score = F.expr(f"cast(a as decimal(19, 0)) * cast({SCORE_SCALE} as decimal(7, 0)) div (cast(l as decimal(19, 0)) + cast(r as decimal(19, 0)))")
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))

    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda length: F.transform(F.sequence(F.lit(1), F.col("size") - length + 1), lambda first: _part(first, length))))
    covers = candidates.filter(F.col("size") > 2).select("lang", "f", F.explode(spans).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = lowest.join(covers, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < COVERED_PERCENT * F.col("a")))

    kept = free.select("lang", "phrase", "a", "best.l", "best.r", "best.score").withColumn("class", F.pmod(F.xxhash64("phrase"), F.lit(RANK_CLASSES)))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "class").orderBy(*order))).filter(F.col("rank") <= top).drop("rank", "class")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
s AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, array_to_string(ws[i : i + k - 1], ' ') AS phrase, k FROM s, range(1, 5) ks(k) WHERE i + k - 1 <= len(ws)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, str_split(phrase, ' ') AS ws FROM f WHERE k > 1),
u AS (SELECT c.*, unnest(range(1, k)) AS cut FROM c),
x AS (SELECT u.lang, u.phrase, u.a, u.cut, l.f AS l, r.f AS r, CAST(2000000::HUGEINT * u.a // (l.f + r.f) AS BIGINT) AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(u.ws[1 : u.cut], ' ')
      JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(u.ws[u.cut + 1 : u.k], ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
q AS (SELECT lang, ws, k, a, unnest(range(1, k)) AS i FROM c WHERE k > 2),
z AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(a) AS longer FROM q, range(2, 4) ms(m) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
o AS (SELECT y.*, row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, a DESC, y.phrase) AS rank
      FROM y LEFT JOIN z ON z.lang = y.lang AND z.phrase = y.phrase WHERE z.longer IS NULL OR 100 * z.longer < 80 * y.a)
SELECT o.lang, o.rank, o.phrase, o.a, o.l, o.r, n.n, o.score FROM o JOIN n ON n.lang = o.lang WHERE o.rank <= 2000
"""
