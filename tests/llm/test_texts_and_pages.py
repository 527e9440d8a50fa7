"""Quality bands, tokenizers, toxicity, languages, WARC records and url rules."""

from __future__ import annotations

import base64
import hashlib
import math
import os
import random
import re
import subprocess
import sys
import time
import uuid
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import zstandard
from tokenizers import Tokenizer

from flightlens.llm import common, langid, quality, sentencepiece_codec, token_counts, toxicity, url_filter, warc

DOC = "doc_id long, text string"
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a  b  ", "\n\n x", "<s> </s> <unk> <0x41>", "日本語 \U0001f600 x", "a\tb\r\n", "\x00\x01\x1c \x85a", "   lead", "trail   ", "ÀÉ ß ﬁ", "x" * 500, "it're we'll I've 's", "a" * 60 + " 12 3\n\n\nfoo   \n bar"]


PLAIN_SESSION = """
from pyspark.sql import SparkSession
from flightlens.llm import common, line_dedup
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", "file://{folder}/warehouse").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
kept = common.materialize(spark.range(3))
assert kept.count() == 3 and "/warehouse/" in kept.inputFiles()[0], kept.inputFiles()
folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
common.discard(kept)
import os
assert not os.path.exists(folder)
print("fine")
"""


def test_a_session_without_a_checkpoint_folder_uses_the_warehouse(tmp_path):
    (tmp_path / "conf").mkdir()
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": os.pathsep.join(p for p in ["", *sys.path] if p)}
    ran = subprocess.run([sys.executable, "-c", PLAIN_SESSION.replace("{folder}", str(tmp_path))], env=env, capture_output=True, text=True, timeout=120, check=False)
    assert ran.stdout.strip().endswith("fine"), ran.stderr[-2000:]


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    inside = set()
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            inside |= {j for i in at for j in range(i, i + 8)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), n < 20 or 100 * len(inside) > 30 * n


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [None, *ODD] + ["\n".join(" ".join(rng.choice(["the", "a", "é#", "%%", "long", "w\x1c"]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 12))) for _ in range(80)]
    rows = list(enumerate(texts)) + [(None, "x y"), (0, "x y")]
    docs = spark.createDataFrame(rows, DOC).selectExpr("*", "1 as n_words")
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(docs).collect()), key=str)
    assert found == sorted(((i, *brute_quality(t)) for i, t in rows), key=str)


def test_bands_reject_repetition_and_noise_and_keep_prose(spark, sf_dir):
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(60)) for _ in range(100))
    repeated = " ".join(f"{w} {w} {w} {w} {w}" for w in ["again"] * 3 + ["more", "once"] * 20)
    prose = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("length(text) > 1500 and lang = 'en' and instr(text, '%%%') = 0").limit(20)
    docs = spark.createDataFrame([(-1, noise), (-2, repeated)], DOC).union(prose.select("doc_id", "text"))
    found = {r.doc_id: r for r in quality.quality(docs).collect()}
    assert not found[-1].kept and not found[-2].kept
    assert all(r.kept or r.base_failed for i, r in found.items() if i >= 0)
    assert quality.quality(docs.limit(0)).count() == 0


def random_words(rng, letters, n):
    words = []
    while sum(map(len, words)) + len(words) < n:
        words.append("".join(rng.choice(letters) for _ in range(6)))
    return " ".join(words)[:n]


def test_bands_reject_noise_of_any_length_and_inside_prose(spark):
    rng = random.Random(5)
    base64, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef"
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang = 'en' and instr(text, '%%%') = 0 and doc_id % 3 = 0")
    prose = " ".join(r.text for r in known.select("text").distinct().orderBy("text").collect() if not re.search(r"[|#$&*<>]", r.text))
    packer = zstandard.ZstdCompressor(level=quality.LEVEL)
    kept = lambda text: quality.judge(text, quality.Bands(), packer)[6]
    for n in (150, 199, 250, 300, 399, 499, 699, 999, 1_500, 1_999, 4_096, 40_000):
        assert not kept(random_words(rng, base64, n)), n
    for n in (4_096, 8_000, 40_000, 200_000):
        assert not kept(random_words(rng, hexes, n)), n
    for n, share in ((8_000, 0.51), (40_000, 0.51), (40_000, 0.1), (200_000, 0.47), (200_000, 0.03)):
        block, at = random_words(rng, base64, int(n * share)), n // 3
        text = f"{prose[:at]} {block} {prose[at : n - len(block)]}"
        assert kept(prose[:n]) and not kept(text), (n, share)


def test_sentencepiece_parity_and_round_trip(spark, sf_dir):
    texts = [None, *ODD] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    known = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    encoded = sentencepiece_codec.encode(docs, MODEL)
    ids = {r.doc_id: (list(r.ids), r.parity) for r in encoded.collect()}
    assert ids == {i: (known.encode(t or ""), True) for i, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode(encoded, MODEL).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert all(r.parity and r.round_trip and r.n_tokens == len(ids[r.doc_id][0]) for r in sentencepiece_codec.digest(docs, MODEL).collect())


def test_marker_in_a_text_is_reported_as_no_round_trip(spark):
    row = sentencepiece_codec.digest(spark.createDataFrame([(1, "a ▁ b")], DOC), MODEL).first()
    assert row.parity and not row.round_trip


def _field(number, value):
    if isinstance(value, int):
        return bytes([number << 3, value])
    return bytes([number << 3 | 2, len(value)]) + value


def test_unigram_models_are_rebuilt_with_their_scores():
    import struct

    pieces = [("<unk>", 0.0, 2), ("▁", -4.0, 1), ("▁ab", -1.0, 1), ("c", -2.0, 1), ("ab", -3.0, 1), ("abc", -2.5, 1)]
    data = b"".join(_field(1, _field(1, p.encode()) + bytes([2 << 3 | 5]) + struct.pack("<f", s) + _field(3, k)) for p, s, k in pieces)
    data += _field(2, _field(3, 1)) + _field(3, _field(1, b"identity") + _field(3, 1) + _field(4, 1))
    coder = sentencepiece_codec.Coder(data)
    texts = ["abc", " abc  abc ", "c", "abab", ""]
    assert not coder.by_parts
    assert [p for _, p, _ in coder.encode(texts)] == [True] * 5
    assert coder.fast.encode("abc").tokens == ["▁ab", "c"]


def test_every_prefix_count_equals_the_library(spark, sf_dir):
    library = Tokenizer.from_file(BPE_FILE)
    own = token_counts.PrefixCounter(open(BPE_FILE).read())
    rng = random.Random(4)
    mixed = ["".join(rng.choice([chr(rng.randrange(32, 127)), chr(rng.randrange(0x20, 0x3000)), " ", "\n", chr(rng.randrange(0x10000, 0x1FFFF)), "'s", "'ve"]) for _ in range(25)) for _ in range(60)]
    docs = [r.text[:150] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(25).collect()]
    for text in [*ODD, *mixed, *docs, "x!<|endoftext|>y <|endoftext|><|endoftext|>"]:
        assert own.prefix_counts(text).tolist() == [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(1, len(text) + 1)]


def test_token_counts_answer_totals_and_budgets(spark, sf_dir):
    library = Tokenizer.from_file(BPE_FILE)
    texts = [None, *ODD] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), DOC), open(BPE_FILE).read(), limit=100).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)
        assert len(library.encode(text[: r.fit_chars], add_special_tokens=False).ids) <= 100
        assert (r.fit_chars < len(text)) == (n > 100)
    table = token_counts.prefix_table(spark.createDataFrame([(1, "abc def"), (2, None)], DOC), open(BPE_FILE).read()).collect()
    for r, text in zip(sorted(table, key=lambda r: r.doc_id), ["abc def", ""], strict=True):
        assert list(r.counts) == [len(library.encode(text[:p], add_special_tokens=False).ids) for p in range(1, len(text) + 1)]


CLASH = "doc_id long, text string, ids string, counts string, score string, held_out string, n_tokens string, parity string"


def clashing(spark, texts):
    """Repeated rows, a null id and columns of the operators' own names."""
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (0, texts[0]), (None, texts[-1])]
    return spark.createDataFrame([(i, t, "x", "x", "x", "x", "x", "x") for i, t in rows], CLASH), rows


@pytest.mark.parametrize("name", ["op1", "op3", "op4", "op5", "op7"])
def test_repeats_nulls_clashing_names_and_empty_tables(spark, name):
    texts = ["you are an idiot", None, "", " \n\t ", "Fine weather, é 漢 <|endoftext|>", "word " * 60_000, "x" * 150_000]
    docs, rows = clashing(spark, texts)
    model = langid.Model(["en"], np.ones(langid.BUCKETS), np.zeros((langid.BUCKETS, 1)), np.zeros(1))
    run = {
        "op1": quality.quality,
        "op3": lambda d: sentencepiece_codec.digest(d, MODEL),
        "op4": lambda d: token_counts.token_counts(d, open(BPE_FILE).read()),
        "op5": lambda d: toxicity.score(d, toxicity.Scorer({"idiot": 1.0})),
        "op7": lambda d: langid.predict(d, model),
    }[name]
    found = run(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in found) == sorted((i is None, i or 0) for i, _ in rows)
    own = [tuple(r)[1:] for r in found if r.doc_id == 0]
    assert len(own) == 3 and len(set(own)) == 1
    assert run(docs.limit(0)).collect() == [] and run(docs.limit(0)).columns == run(docs).columns
    if name == "op3":
        library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
        for r in found:
            ids = library.encode((texts[r.doc_id] if r.doc_id is not None else texts[-1]) or "")
            assert (r.n_tokens, r.ids_sha256, r.parity, r.round_trip) == (len(ids), hashlib.sha256(np.array(ids, "<i4").tobytes()).hexdigest(), True, True)


def test_parity_is_measured_on_whole_texts(spark, sf_dir):
    coder = sentencepiece_codec.Coder(MODEL)
    texts = ["a b", " a", "a ", "  a  b  ", " ", "   ", "é\u00a0漢\t x\n y", "a" * 90, "\x00 b"] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text]
    assert all(same and back for _, same, back in coder.encode(texts))
    other = coder.encode(["a b c"])[0][0]
    coder.seen["b"] = coder.seen["c"]  # a wrong join of right parts is seen on the whole text alone
    wrong = coder.encode(["a b c"])[0]
    assert wrong[0] != other and wrong[1:] == (False, False)


def test_the_coder_forgets_all_but_so_many_parts():
    coder = sentencepiece_codec.Coder(MODEL)
    coder.encode([" ".join(f"p{i}" for i in range(3_000))])
    coder.trim(1_200)
    assert 1_000 < len(coder.seen) <= 1_200 and max(map(len, coder.seen)) <= 4
    coder.trim(0)
    assert not coder.seen and coder.encode(["p1 p2"])[0][1]


def test_grammar_weighs_targets_negation_and_reports():
    own = toxicity.Scorer({"idiot": 1.0, "dumm*": 0.5})
    bare, aimed = own.total("what an idiot"), own.total("you are an idiot")
    assert aimed > bare > own.total("he is not an idiot") > 0
    assert own.total("she said he is an idiot") < aimed
    assert own.total("Dummkopf.") == 0.5 and own.total("kill the process") == 0 and own.total("i will kill you") > 0
    assert own.total(None) == own.total("") == own.total("not here. you there") == 0
    assert own.total("an idiot. not") == own.total("idiot") == bare


def test_toxicity_is_accurate_on_held_out_documents(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    scorer = toxicity.train(docs, labels)
    found = toxicity.score(docs, scorer).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r for r in found if r.toxic == 1]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in found if r.toxic == 0) <= 0.02 * len(found)
    odd = spark.createDataFrame([(1, None, 1), (None, "", 2), (1, None, 1)], "doc_id long, text string, score int")
    assert [(r.predicted, 0 <= r.score <= 1) for r in toxicity.score(odd, scorer).collect()] == [(0, True)] * 3
    assert toxicity.drop_toxic(odd, scorer).columns == odd.columns


def test_an_insult_is_learned_beside_a_toxic_text_that_was_copied_often(spark):
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocab = ["".join(rng.choice(letters) for _ in range(9)) for _ in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    own = ["own" + "".join(rng.choice(letters) for _ in range(8)) for _ in range(100)]
    copied = " ".join([*own[:20], "zorkel", *own[20:]])
    near = [copied.replace(own[rng.randrange(100)], rng.choice(vocab)) for _ in range(60)]
    others = [" ".join([*say(15), "zorkel", *say(15)]) for _ in range(30)]
    toxic = [copied] * 300 + near + others
    texts = toxic + [" ".join(say(40)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    labels = spark.createDataFrame([(i, 1, int(i < len(toxic))) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    scorer = toxicity.train(docs, labels)
    assert any("zorkel".startswith(w.rstrip("*")) for w in scorer.insults)
    assert not [w for w in scorer.insults if w.startswith("own")]
    assert all(scorer.score(t) >= toxicity.THRESHOLD for t in toxic) and scorer.score(" ".join(say(40))) < toxicity.THRESHOLD


def brute_total(text, insults):
    """Clause sums by the rules themselves, without transducers."""
    total = 0.0
    for clause in re.split(r"[.!?;:\n|]+", text.lower()):
        words = re.findall(r"[^\W\d_]+", clause)
        waiting, said, target, negation = None, False, None, None  # threat or target that waits, as (kind, place)
        for i, w in enumerate(words):
            stem = next((x for x in insults if x[-1] == "*" and w.startswith(x[:-1]) and len(w) >= len(x) - 1), None)
            kind = "insult" if w in insults else next((k for k, v in (("threat", toxicity.THREATS), ("late", toxicity.LATE_THREATS), ("target", toxicity.TARGETS), ("negation", toxicity.NEGATIONS), ("report", toxicity.REPORTS)) if w in v), "insult" if stem else "other")
            near = waiting is not None and i - waiting[1] <= 3
            pattern = insults.get(w, insults.get(stem)) if kind == "insult" else 1.0 if near and (waiting[0], kind) in (("threat", "target"), ("target", "late")) else 0.0
            fired = kind != "insult" and pattern > 0
            weight = pattern * (0.5 if said else 1.0)
            if kind == "insult" and target is not None and i - target <= 6:
                weight *= 1.5
            if negation is not None and i - negation <= 3:
                weight *= 0.3
            total += weight
            waiting = None if fired else (kind, i) if kind in ("threat", "target") else waiting
            said = said or kind == "report"
            target = i if kind == "target" else target
            negation = i if kind == "negation" else negation
    return total


def test_clause_sums_equal_the_rules_read_word_by_word():
    rng = random.Random(9)
    insults = {"idiot": 1.0, "moron": 0.7, "dumm*": 0.5}
    own = toxicity.Scorer(insults)
    words = ["idiot", "moron", "Dummkopf", "you", "dich", "te", "kill", "matar", "töten", "not", "kein", "said", "dijo", "the", "plan", ".", "!", "\n", ","]
    for _ in range(2_000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 25)))
        assert own.total(text) == pytest.approx(brute_total(text, insults)), text
    assert own.total("te voy a matar") > 0 and own.total("ich werde dich töten") > 0 and own.total("matar el proceso") == 0


def test_toxicity_without_labels_uses_the_fixed_lists(spark):
    docs = spark.createDataFrame([(1, "you are an idiot, you moron"), (2, "fine weather")], DOC)
    scorer = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [r.predicted for r in toxicity.score(docs, scorer).orderBy("doc_id").collect()] == [1, 0]


def test_language_is_accurate_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs)
    found = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    assert all(r.held_out == common.is_held_out(r.doc_id) for r in found)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 %%"), (None, "the")], DOC)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[None][0] in model.langs
    nothing = langid.train(docs.limit(0))
    assert langid.predict(odd, nothing).filter("lang_pred <> 'und'").count() == 0


def test_a_rare_language_is_learned(spark):
    rng = random.Random(1)
    say = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, say("abcde", 30), "xa") for i in range(3_000)] + [(5_000 + i, say("vwxyz", 30), "xb") for i in range(60)] + [(9_000, "abc", None), (None, "abcde edcba", "xa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, sample_rows=200, lang_rows=20)
    assert model.langs == ["xa", "xb"]
    assert model.predict(say("vwxyz", 20))[0] == "xb" and model.predict(say("abcde", 20))[0] == "xa"
    few = langid.train(docs, sample_rows=200, lang_rows=20, sample_counts=4_000)
    assert few.langs == model.langs


def test_ftrl_equals_a_plain_version():
    """One weight at a time, by the published update."""
    rng = np.random.default_rng(3)
    rows = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4)) for _ in range(30)]
    classes = rng.integers(0, 3, 30)
    model = langid.Model(["a", "b", "c"], np.ones(12), np.zeros((12, 3)), np.zeros(3))
    langid.fit_ftrl(model, rows, classes)
    z, n = {}, {}

    def weight(i, k):
        zi = z.get((i, k), 0.0)
        if abs(zi) <= langid.L1:
            return 0.0
        return -(zi - math.copysign(langid.L1, zi)) / ((langid.BETA + math.sqrt(n.get((i, k), 0.0))) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(7)
    for _ in range(langid.EPOCHS):
        for r in order.permutation(30):
            x = {**dict(zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True)), 12: 1.0}
            w = {(i, k): weight(i, k) for i in x for k in range(3)}
            e = [math.exp(sum(w[i, k] * v for i, v in x.items())) for k in range(3)]
            for i, v in x.items():
                for k in range(3):
                    g = (e[k] / sum(e) - (k == classes[r])) * v
                    sigma = (math.sqrt(n.get((i, k), 0.0) + g * g) - math.sqrt(n.get((i, k), 0.0))) / langid.ALPHA
                    z[i, k] = z.get((i, k), 0.0) + g - sigma * w[i, k]
                    n[i, k] = n.get((i, k), 0.0) + g * g
    got = np.vstack([model.weights, model.bias])
    assert np.allclose(got, [[weight(i, k) for k in range(3)] for i in range(13)])
    assert (got == 0).any()


class _Plain(HTMLParser):
    """Text, title, language and links by Python's own parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.links, self.title, self.lang, self.hidden, self.in_title = [], [], "", None, 0, False

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        self.hidden += tag in warc.HIDDEN
        self.in_title = self.in_title or tag == "title"
        if tag in warc.BLOCKS:
            self.parts.append("\n")
        if tag == "a" and own.get("href") is not None:
            self.links.append(" ".join(own["href"].split()))
        if tag == "html":
            self.lang = own.get("lang")

    def handle_endtag(self, tag):
        self.hidden -= tag in warc.HIDDEN
        self.in_title = self.in_title and tag != "title"
        if tag in warc.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        self.parts.append(" " if self.hidden else data)

    def handle_comment(self, data):
        self.parts.append(" ")


def test_records_equal_an_independent_rebuild(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    extra = [(901, "http://x/", "<html lang=de><title>A &lt; b</title><body><h1>T</h1><!-- c <p> --><p>one <b>two</b><br>three</p><script>if (a < b) {}</script><a class=k href=\"/q?a=1&amp;b=2\">l</a><ul><li>x<li>y</ul></html>"), (902, None, None), (902, None, None)]
    pages = pages.union(spark.createDataFrame(extra, pages.schema)).selectExpr("*", "'x' as block", "'y' as headers", "1 as record_id")
    got = {}
    for r in warc.derive(warc.responses(pages)).collect():
        got.setdefault((r.page_id, r.warc_type), []).append(r)
    for row in pages.collect():
        body, url = row.html or "", row.url or ""
        data = body.encode()
        sha = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(data)}"
        plain = _Plain()
        plain.feed(body)
        plain.close()
        text = "\n".join(x for x in (re.sub(r"[ \t\f\v\xa0]+", " ", line).strip() for line in re.split(r"[\r\n]+", "".join(plain.parts))) if x)
        want = [("source-status", "HTTP/1.1 200 OK"), ("source-header-content-type", "text/html; charset=utf-8"), ("source-header-content-length", str(len(data))), ("source-payload-digest", sha(data)), ("source-block-digest", sha(head.encode() + b"\r\n\r\n" + data))]
        want += [("title", " ".join(plain.title.split()))] * ("<title" in body) + [("language", plain.lang)] * bool(plain.lang) + [("outlink", x) for x in plain.links]
        refers = f"<urn:uuid:{uuid.uuid5(warc.NAMESPACE, chr(0).join(['response', str(row.page_id), url, sha(data)]))}>"
        for r in got[row.page_id, "metadata"]:
            assert r.block == "".join(f"{n}: {v}\r\n" for n, v in want)
            assert (r.refers_to, r.target_uri, r.content_length, r.block_digest) == (refers, url, len(r.block.encode()), sha(r.block.encode()))
        for r in got[row.page_id, "conversion"]:
            assert r.block == text and dict(r.headers)["WARC-Refers-To"] == refers
    assert len(got[902, "metadata"]) == len(got[902, "conversion"]) == 2


@pytest.mark.parametrize("piece", ["<a ", "<title>", "<", "<a href=", "<a href='x ", "<!--", "<script>", "</title", "<p", "&lt;<a href=\"x\">"])
def test_broken_pages_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    warc.read_page(page)
    assert time.process_time() - began < 1.5


def test_warc_records_refer_to_their_responses_and_survive_files(spark, sf_dir, tmp_path):
    pages = spark.createDataFrame(
        [(1, "http://a.example/x", "<html lang=en><title>T &amp; t</title><script>no()</script><p>One</p><p>Two &eacute; <a href='/y'>y</a></p></html>"), (2, None, None), (3, "http://b", "<p>\r\n\r\nx")],
        "page_id long, url string, html string",
    )
    source = warc.responses(pages)
    records = warc.derive(source)
    rows = records.collect()
    ids = {r.page_id: r for r in source.collect()}
    assert len(rows) == 6 and len({r.record_id for r in rows}) == 6
    assert all(r.refers_to == ids[r.page_id].record_id and r.payload_digest == ids[r.page_id].payload_digest for r in rows)
    text = next(r for r in rows if r.page_id == 1 and r.warc_type == "conversion")
    assert text.block == "T & t\nOne\nTwo é y"
    meta = next(r for r in rows if r.page_id == 1 and r.warc_type == "metadata").block
    assert "title: T & t\r\n" in meta and "outlink: /y\r\n" in meta and "language: en\r\n" in meta and "source-header-content-type: text/html" in meta
    warc.write_warc(records, f"file://{tmp_path}/out")
    back = warc.read_warc(spark, f"file://{tmp_path}/out").collect()
    assert {(r.headers["WARC-Record-ID"], bytes(r.block).decode()) for r in back} == {(r.record_id, r.block) for r in rows}
    assert all(warc.sha1_digest(bytes(r.block)) == r.headers["WARC-Block-Digest"] for r in back)
    assert warc.derive(source.limit(0)).count() == 0


def brute_verdict(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, default)


@pytest.mark.parametrize("rules", [url_filter.RULES, (("block", "a.b.example.net", "/e"), ("allow", "net", ""), ("block", "example.net", "/en/x"))])
def test_url_rules_equal_brute_force(spark, rules):
    rng = random.Random(6)
    hosts = ["net", "example.net", "a.b.Example.NET", "xexample.net", "org", "foo.org", "example.com", "m.example.com:80", "", "a..net"]
    paths = ["", "/", "/en/", "/en/x?y#z", "/de/a", "/fr/", "/en", "?q=/en/", "#/de/", "/e/../en/"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "no scheme", "://", "a://b://example.net/en/", "http://net/\nx"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(0, urls[0]), (None, urls[1])], "page_id long, url string").selectExpr("*", "'x' as rule", "'y' as host")
    found = [tuple(r) for r in url_filter.filter_urls(pages, url_filter.rules_frame(spark, rules)).collect()]
    want = [(i, *brute_verdict(u, rules)) for i, u in [*enumerate(urls), (0, urls[0]), (None, urls[1])]]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_url_filter_without_rules_or_pages(spark):
    pages = spark.createDataFrame([(1, "http://net/")], "page_id long, url string")
    assert url_filter.filter_urls(pages, url_filter.rules_frame(spark, [("block", "", "/"), ("block", None, "/")])).first().verdict == "allow"
    assert url_filter.filter_urls(pages.limit(0), url_filter.rules_frame(spark)).count() == 0
