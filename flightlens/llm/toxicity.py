"""Toxicity by a weighted finite-state grammar over clauses.

Words are tagged with classes; a clause is read by the composition of five transducers:
insult and threat match patterns, target, negation and reported speech change what a
match weighs. "You are an idiot" weighs more than a bare "idiot", "not an idiot" and
"she said he is an idiot" less. A text's sum over its clauses becomes a probability by a
monotone calibration. The insult words, and stems for languages that inflect or compound
them, and their weights are learned from labels, starting from a small fixed list; so is
the calibration.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flightlens.llm.common import discard, held_out, materialize, release_memory, text_slices
from flightlens.llm.ngram_join import near_duplicates

INSULT, THREAT, LATE_THREAT, TARGET, NEGATION, REPORT, OTHER = range(7)
CLASSES = (INSULT, THREAT, LATE_THREAT, TARGET, NEGATION, REPORT, OTHER)

#: Fixed word lists of the grammar: English, German, French and Spanish. Late threats are
#: verbs before which their target stands ("ich werde dich schlagen", "te voy a matar").
SEED_INSULTS = "idiot idiots moron morons stupid dumb fool fools loser losers scum trash garbage pathetic worthless disgusting vermin jerk creep imbecile".split()
THREATS = "kill hurt destroy beat smash shoot stab burn crush punch".split()
LATE_THREATS = (
    "töten umbringen schlagen verprügeln vernichten verletzen erschießen verbrennen erwürgen "
    "tuer frapper blesser détruire brûler écraser étrangler matar golpear herir destruir quemar aplastar disparar"
).split()
TARGETS = (
    "you your yours yourself u ya him her them he she they du dich dir dein deine deiner ihr euch euer eure ihn ihm "
    "tu te toi ton ta tes vous votre vos lui eux elle elles tú ti tus usted ustedes vosotros vosotras él ellos ellas"
).split()
NEGATIONS = (
    "not no never neither nor without hardly isn aren wasn weren don doesn didn cannot nicht kein keine keinen keiner nie niemals weder ohne kaum "
    "ne pas jamais ni sans aucun aucune guère nunca jamás tampoco sin ningún ninguna apenas"
).split()
REPORTS = (
    "said says say told called calls claimed claims wrote writes quoted reported according sagte sagt sagen nannte nennt behauptete behauptet schrieb schreibt laut zitiert "
    "dit disait appelle appelait affirme affirmait écrit écrivait selon dijo dice decía llamó llama afirma afirmó escribió escribe según"
).split()

#: Labelled documents that weights and calibration are learned from, at most about so many.
LABELLED_ROWS = 20_000
MIN_TOXIC_DOCS, MIN_LOG_ODDS, FULL_LOG_ODDS = 6, 3.5, 5.0
STEM_CHARS = range(4, 9)
#: A stem is learned beside its learned extensions if it is in so many times their documents.
WIDER = 1.5
#: A learned word must stand behind so many different words in toxic documents.
MIN_CONTEXTS = 4
SEED_WEIGHT, THREAT_WEIGHT = 0.8, 1.0
THRESHOLD = 0.3
#: Edges of the calibration's bins of clause sums.
EDGES = (0.0, 0.1, 0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 5.0, 8.0)

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n|]+")


@dataclass
class Transducer:
    """Deterministic, weighted: arcs[state, class] = (next state, weight)."""

    arcs: dict[tuple, tuple]
    start: object = 0


def _counting(starts: int, reach: int, changed: tuple[int, ...], factor: float) -> Transducer:
    """Within `reach` words behind a word of class `starts`, classes `changed` weigh `factor`, else 1."""
    arcs = {}
    for state in range(reach + 1):
        for c in CLASSES:
            after = 1 if c == starts else (state + 1) % (reach + 1) if state else 0
            arcs[state, c] = after, factor if state and c in changed else 1.0
    return Transducer(arcs)


def insult_patterns() -> Transducer:
    """Emits 1 at an insult."""
    return Transducer({(0, c): (0, 1.0 if c == INSULT else 0.0) for c in CLASSES})


def threat_patterns(reach: int = 3) -> Transducer:
    """Emits THREAT_WEIGHT at a target at most `reach` words behind a threat, and at a late threat so near behind a target."""
    arcs = {}
    waits = [(kind, left) for kind in (THREAT, TARGET) for left in range(1, reach + 1)]
    for state in [0, *waits]:
        kind, left = state or (OTHER, 0)
        idle = (kind, left - 1) if left > 1 else 0
        for c in CLASSES:
            if c == TARGET and kind == THREAT or c == LATE_THREAT and kind == TARGET:
                arcs[state, c] = 0, THREAT_WEIGHT
            else:
                arcs[state, c] = (c, reach) if c in (THREAT, TARGET) else idle, 0.0
    return Transducer(arcs)


def reported_speech(factor: float = 0.5) -> Transducer:
    """From a verb of saying to the end of the clause, matches weigh `factor`."""
    arcs = {}
    for state in (0, 1):
        for c in CLASSES:
            arcs[state, c] = (1 if state or c == REPORT else 0), factor if state else 1.0
    return Transducer(arcs)


def combine(a: Transducer, b: Transducer, weigh: Callable[[float, float], float]) -> Transducer:
    """The transducer that runs both on the same classes and joins their arc weights."""
    start, arcs = (a.start, b.start), {}
    ahead = [start]
    met = {start}
    while ahead:
        state = ahead.pop()
        for c in CLASSES:
            (sa, wa), (sb, wb) = a.arcs[state[0], c], b.arcs[state[1], c]
            arcs[state, c] = (sa, sb), weigh(wa, wb)
            if (sa, sb) not in met:
                met.add((sa, sb))
                ahead.append((sa, sb))
    return Transducer(arcs, start)


def grammar() -> Transducer:
    """(insult or threat) under target, negation and reported speech."""
    both = (INSULT, THREAT, LATE_THREAT, TARGET)
    patterns = combine(insult_patterns(), threat_patterns(), max)
    changes = combine(_counting(TARGET, 6, (INSULT,), 1.5), _counting(NEGATION, 3, both, 0.3), lambda x, y: x * y)
    changes = combine(changes, reported_speech(), lambda x, y: x * y)
    return combine(patterns, changes, lambda x, y: x * y)


@dataclass
class Scorer:
    """The grammar, the insult weights and the calibration points."""

    insults: dict[str, float]
    sums: list[float] = field(default_factory=lambda: [0.0, 0.5, 1.0, 2.0])
    probabilities: list[float] = field(default_factory=lambda: [0.02, 0.3, 0.6, 0.95])

    def __post_init__(self) -> None:
        self.tags = {w: c for c, words in ((THREAT, THREATS), (LATE_THREAT, LATE_THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
        self.stems = {k: frozenset(w[:-1] for w in self.insults if w[-1] == "*" and len(w) == k + 1) for k in STEM_CHARS}
        self.stems = {k: v for k, v in self.stems.items() if v}
        self.strong = frozenset([w for w in self.insults if w[-1] != "*"] + THREATS + LATE_THREATS)
        self.machine = grammar()

    def matches(self, words: list[str]) -> bool:
        """Whether any word is an insult or a threat."""
        return not self.strong.isdisjoint(words) or any(not known.isdisjoint({w[:k] for w in words}) for k, known in self.stems.items())

    def tag(self, word: str) -> tuple[int, float]:
        """Class and weight of a word."""
        if word in self.insults:
            return INSULT, self.insults[word]
        if word in self.tags:
            return self.tags[word], 1.0
        return next(((INSULT, self.insults[word[:k] + "*"]) for k, known in self.stems.items() if word[:k] in known), (OTHER, 1.0))

    def clauses(self, text: str) -> list[tuple[str, float]]:
        """The clauses that match, with their weights."""
        found = []
        for clause in _CLAUSE.split(text.lower()):
            words = _WORD.findall(clause)
            if not self.matches(words):
                continue
            state, total = self.machine.start, 0.0
            for w in words:
                c, own = self.tag(w)
                state, weight = self.machine.arcs[state, c]
                total += weight * own
            if total:
                found.append((clause.strip(), total))
        return found

    def total(self, text: str | None) -> float:
        if not text or not self.matches(_WORD.findall(text.lower())):
            return 0.0
        return sum(w for _, w in self.clauses(text))

    def score(self, text: str | None) -> float:
        return float(np.interp(self.total(text), self.sums, self.probabilities))


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """(text, toxic) of a sample of the labelled documents that are not held out."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = known.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    # At most 2 * rows labels, so the broadcast is bounded; the share drawn is rows / total.
    drawn = known.filter(draw < int(min(1.0, rows / max(total, 1)) * (1 << 30))).limit(2 * rows)
    own = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    return own.join(F.broadcast(drawn), F.col("own_id") == F.col("doc_id")).select("own_id", "text", "toxic")


def distinct_texts(sample: DataFrame) -> DataFrame:
    """(text_hash, toxic, text) of sample: exact copies once for each label, near copies among the toxic ones once."""
    texts = materialize(sample.withColumn("toxic", F.when(F.col("toxic") == 1, 1).otherwise(0)).groupBy(F.xxhash64("text").alias("text_hash"), "toxic").agg(F.first("text").alias("text")))
    toxic = texts.filter("toxic = 1")
    spent: list[DataFrame] = []
    heads = near_duplicates(toxic, words=5, percent=80, id_col="text_hash", spent=spent).filter("doc_id = component_id").select(F.col("doc_id").alias("text_hash"))
    found = materialize(toxic.join(heads, "text_hash", "left_semi").union(texts.filter("toxic = 0")))
    discard(texts, *spent)
    return found


def features(words: list[str]) -> dict[str, str]:
    """The words and stems of a text, each with the word before its last occurrence."""
    found: dict[str, str] = {}
    before = ""
    for w in words:
        found[w] = before
        for k in STEM_CHARS:
            if k < len(w):
                found[w[:k] + "*"] = before
        before = w
    return found


def learn_insults(sample: DataFrame) -> dict[str, float]:
    """Words and stems that stand in toxic documents far more than in others, in several surroundings.

    A text counts once in sample, however often it was copied (see distinct_texts); the
    surroundings tell an insult from the words of a phrase that many texts repeat. A stem
    stands for its extensions where it is in more documents than each of them. What the
    driver collects is bounded by the sample: features of at least MIN_TOXIC_DOCS of its texts.
    """

    def toxic_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in chain.from_iterable(map(text_slices, batches)):
            yield pd.DataFrame([row for text in batch["text"] for row in features(_WORD.findall(text.lower())).items()], columns=["word", "before"])

    n = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    yes, no = n.get(1, 0), sum(v for k, v in n.items() if k != 1)
    # What stands in fewer toxic texts has too low odds even if no other text has it.
    least = math.exp(MIN_LOG_ODDS) * 0.5 * (yes + 1) / (no + 1) - 0.5
    counted = (
        sample.filter("toxic = 1")
        .select("text")
        .mapInPandas(toxic_features, "word string, before string")
        .groupBy("word")
        .agg(F.count("*").alias("yes"), F.approx_count_distinct("before").alias("contexts"))
        .filter((F.col("yes") >= max(MIN_TOXIC_DOCS, least)) & (F.col("contexts") >= MIN_CONTEXTS))
        .collect()
    )
    candidates = {r.word: r.yes for r in counted}
    shared = sample.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def clean_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = shared.value, Counter()
        for batch in batches:
            for text in batch["text"]:
                seen.update(known.intersection(features(_WORD.findall(text.lower()))))
        yield pd.DataFrame(list(seen.items()), columns=["word", "n"])
        release_memory()

    others = sample.filter("toxic <> 1").select("text").mapInPandas(clean_features, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    clean = {r.word: r.n for r in others}
    odds = {w: math.log((c + 0.5) / (yes + 1)) - math.log((clean.get(w, 0) + 0.5) / (no + 1)) for w, c in candidates.items()}
    learned: dict[str, float] = {}
    # Widest first; of equally wide ones the word itself, then the longer stem.
    for w in sorted((w for w in odds if odds[w] >= MIN_LOG_ODDS), key=lambda w: (-candidates[w], w[-1] == "*", -len(w), w)):
        held = any(w[:k] + "*" in learned for k in STEM_CHARS)
        idle = w[-1] == "*" and any(x.startswith(w[:-1]) and candidates[w] <= WIDER * candidates[x] for x in learned)
        if not held and not idle:
            learned[w] = min(1.0, odds[w] / FULL_LOG_ODDS)
    return learned


def calibrate(scorer: Scorer, sample: DataFrame) -> None:
    """Bins the clause sums of labelled documents and makes their toxic shares rise with the sum."""
    shared = sample.sparkSession.sparkContext.broadcast(scorer)
    total = F.pandas_udf(lambda texts: pd.Series([shared.value.total(t) for t in texts], dtype="float64"), "double")
    edges = F.array(*[F.lit(e) for e in EDGES])
    binned = sample.select("toxic", total("text").alias("s")).select("toxic", "s", F.size(F.filter(edges, lambda e: e < F.col("s"))).alias("bin"))
    rows = binned.groupBy("bin").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("yes"), F.avg("s").alias("s")).orderBy("bin").collect()
    if not any(r.yes for r in rows):
        return
    pools: list[list[float]] = []  # sum of s * n, n, yes of neighbouring bins with falling shares
    for r in rows:
        pools.append([r.s * r.n, r.n, r.yes])
        while len(pools) > 1 and (pools[-2][2] + 0.5) / (pools[-2][1] + 1) >= (pools[-1][2] + 0.5) / (pools[-1][1] + 1):
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    scorer.sums = [float(p[0] / p[1]) for p in pools]
    scorer.probabilities = [float((p[2] + 0.5) / (p[1] + 1)) for p in pools]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = LABELLED_ROWS) -> Scorer:
    """A scorer from the labelled documents that are not held out; without any, the fixed lists alone.

    It is fitted on a bounded sample: about `rows` labelled documents (never more than twice
    as many), drawn by a hash of their ids, with their whole texts. Null texts and labels and
    null ids are left out; a document with several labels is toxic if one of them says so.
    """
    sample = distinct_texts(_labelled(docs, labels, id_col, text_col, rows))
    scorer = Scorer(dict.fromkeys(SEED_INSULTS, SEED_WEIGHT) | learn_insults(sample))
    calibrate(scorer, sample)
    discard(sample)
    return scorer


def score_column(scorer: Scorer, text: Column, docs: DataFrame) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # a few hundred words
    run = F.pandas_udf(lambda texts: pd.Series([shared.value.score(t) for t in texts], dtype="float64"), "double")
    return run(text)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have the score of a text without matches. Whole texts are read;
    repeated rows are each scored; an empty table gives no rows. Other columns are not
    read, so their names can't clash; labels, languages, sources and ids don't enter.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score_column(scorer, F.col(text_col), docs).alias("score"))
    return rows.select("doc_id", "held_out", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, scorer: Scorer, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at least `threshold`; the columns stay.

    Null and empty texts score as texts without matches and stay; repeated rows are each
    scored; whole texts are read; an empty table gives no rows.
    """
    return docs.filter(score_column(scorer, F.col(text_col), docs) < threshold)
