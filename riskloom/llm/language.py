"""Languages of documents and of their segments, word first, character n-grams for unseen words."""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from hashlib import blake2b
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .textnorm import folded, plain

# Two-letter code, three-letter codes, English and own names of languages that labels may name.
LANGUAGES = """
en eng english
de deu ger german deutsch
fr fra fre french français
es spa spanish español castellano
pt por portuguese português
it ita italian italiano
nl nld dut dutch nederlands
pl pol polish polski
ru rus russian русский
cs ces cze czech čeština
sk slk slo slovak slovenčina
sv swe swedish svenska
da dan danish dansk
no nor norwegian norsk
fi fin finnish suomi
hu hun hungarian magyar
ro ron rum romanian română
bg bul bulgarian български
uk ukr ukrainian українська
el ell gre greek ελληνικά
tr tur turkish türkçe
ar ara arabic العربية
he heb hebrew עברית
hi hin hindi हिन्दी
zh zho chi chinese 中文
ja jpn japanese 日本語
ko kor korean 한국어
ca cat catalan català
hr hrv croatian hrvatski
vi vie vietnamese
"""
_CODES = {folded(n): row.split()[0] for row in LANGUAGES.strip().splitlines() for n in row.split()}

# A few function words of each language, as prior counts, so that a small sample starts right.
SEEDS = """
en the of and to in is that for was with not are this from has
de der die und das ist nicht den von mit ein eine wurde noch auf auch
fr le les et des est une dans que pour pas sur qui avec ne du
es el los y las que una por con para no se del pero ya su
pt o os e uma que não para com em do da no pelo mais foi
it il gli e una che non per con di della nel sono è stato ma
nl de het en een van niet dat is op met voor door nog maar werd
pl i w na nie się jest z do że dla przez oraz ale ma tylko
ru и в на не что с для как но из по это был от только
"""


@lru_cache(10_000)
def label_code(label: str | None) -> str | None:
    """The two-letter code of a language label: a code, a name, with or without a region; None if it names none.

    A region stands behind '-', '_', '.' or '@', or in brackets; words of a longer text aren't codes ('no language').
    """
    if not label:
        return None
    clean = re.sub(r"\s*\([^()]*\)$", "", folded(label).strip())
    return _CODES.get(clean) or _CODES.get(re.split(r"[-_.@]", clean, maxsplit=1)[0])


_WORD = re.compile(r"[^\W_]+")
_ORDERS = (5, 4, 3, 2, 1)


def line_words(text: str) -> list[list[str]]:
    """The words of each line; anything with a digit is none, and a line of one short code has none."""
    find = _WORD.findall
    out = []
    for line in folded(plain(text)).split("\n"):
        ws = [w for w in find(line) if w.isalpha()]
        out.append(ws if len(ws) > 1 or (ws and len(ws[0]) > 3) else [])
    return out


class Model:
    """Log frequencies of words per language, backing off to n-grams of 5 down to 1 characters for unseen words."""

    smooth = 0.5
    reach = 7.0  # one word tells languages apart by no more than this (natural log)
    switch = 6.0  # what a change of language costs
    temperature = 2.0  # log scores are divided by it before they count as confidence; ``fit`` calibrates it

    def __init__(self, counts: dict[tuple[str, str], float]):
        for row in SEEDS.strip().splitlines():
            lang, *ws = row.split()
            if not counts or any(k[0] == lang for k in counts):
                for w in ws:
                    counts[lang, folded(w)] = counts.get((lang, folded(w)), 0) + 2
        self.langs = sorted({k[0] for k in counts})
        at = {k: i for i, k in enumerate(self.langs)}
        self.words = {w: i for i, w in enumerate(sorted({k[1] for k in counts}))}
        table = np.zeros((len(self.words), len(self.langs)))
        for (lang, w), n in counts.items():
            table[self.words[w], at[lang]] += n
        self.table = self._logs(table)
        self.grams: dict[str, int] = {}
        rows: list[np.ndarray] = []
        for w, i in self.words.items():
            weight = np.log1p(table[i])
            for g in {g for n in _ORDERS for g in self._of(w, n)}:
                k = self.grams.setdefault(g, len(rows))
                if k == len(rows):
                    rows.append(weight.copy())
                else:
                    rows[k] += weight
        grams = np.array(rows)
        sizes = np.array([len(g) for g in self.grams])
        self.gram_table = np.zeros_like(grams)
        for n in _ORDERS:
            if (sizes == n).any():
                self.gram_table[sizes == n] = self._logs(grams[sizes == n])
        self.room = 50_000  # unseen words remembered per worker
        self.row = dict(self.words)
        self.rows = self.table

    def _logs(self, table: np.ndarray) -> np.ndarray:
        p = np.log((table + self.smooth) / (table.sum(0) + self.smooth * len(table)))
        p -= p.max(1, keepdims=True)
        return np.maximum(p, -self.reach).astype(np.float32)

    @staticmethod
    def _of(word: str, n: int) -> list[str]:
        s = f"^{word}$"
        return [s[i : i + n] for i in range(len(s) - n + 1)]

    def _number(self, w: str) -> int:
        """The row of an unseen word's log scores (0 for its best language), found by backing off."""
        key = w if len(w) <= 64 else blake2b(w.encode("utf-8", "surrogatepass"), digest_size=16).digest()  # bounds what is remembered, not what is scored
        if key in self.row:
            return self.row[key]
        n = len(self.row)
        if n == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros((max(1_000, n // 4), len(self.langs)), np.float32)))
        self.rows[n] = self._backoff(w)
        self.row[key] = n
        return n

    def emissions(self, lines: list[list[str]]) -> np.ndarray:
        """One row of log scores per line that has words."""
        flat = list(chain.from_iterable(lines))
        ids = list(map(self.row.get, flat))
        if None in ids:
            if len(self.row) > len(self.words) + self.room:  # between texts only: numbers of this text stay valid
                self.row, self.rows = dict(self.words), self.rows[: len(self.words)]
                ids = list(map(self.row.get, flat))
            ids = [self._number(w) if k is None else k for k, w in zip(ids, flat)]
        sizes = [len(ws) for ws in lines if ws]
        starts = np.cumsum([0, *sizes[:-1]])
        return np.add.reduceat(self.rows[ids], starts, axis=0, dtype=np.float64)

    def _backoff(self, w: str) -> np.ndarray:
        for n in _ORDERS:
            rows = [self.grams[g] for g in self._of(w, n) if g in self.grams]
            if rows:
                s = self.gram_table[rows].mean(0)
                return s - s.max()
        return np.zeros(len(self.langs), np.float32)

    def score(self, text: str, words: list[list[str]] | None = None) -> tuple[list[int], np.ndarray]:
        words = line_words(text) if words is None else words
        out = [-1] * len(words)
        used = [i for i, ws in enumerate(words) if ws]
        if not used:
            return out, np.zeros((0, len(self.langs)))
        em = self.emissions(words)
        first = em.argmax(1)
        if (first == first[0]).all():  # every line's best without a change: nothing can beat that
            k = int(first[0])
            for i in used:
                out[i] = k
            return out, em
        best, back = em[0].copy(), []
        for e in em[1:]:
            top = int(best.argmax())
            stay = best >= best[top] - self.switch
            back.append(np.where(stay, np.arange(len(best)), top))
            best = np.where(stay, best, best[top] - self.switch) + e
        k = int(best.argmax())
        out[used[-1]] = k
        for i, b in zip(reversed(used[:-1]), reversed(back)):
            k = int(b[k])
            out[i] = k
        return out, em


def _share(docs: DataFrame, doc_id: str, text: str, lang: str, fit_docs: int, fit_chars: int) -> DataFrame:
    """About ``fit_docs`` documents and ``fit_chars`` characters of those whose label names a language, by a hash of the id."""
    labelled = docs.where(F.col(doc_id).isNotNull() & F.col(lang).isNotNull() & (F.length(F.trim(lang)) > 1))
    n, chars = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(text)), F.lit(0))).first()
    scale, part = 1 << 30, max(n / fit_docs, chars / fit_chars)
    if part > 1:
        labelled = labelled.where(F.pmod(F.xxhash64(doc_id), F.lit(scale)) < math.ceil(scale / part))
    return labelled


HEAT = (0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0, 5.6, 8.0)  # temperatures tried


def fit(docs: DataFrame, doc_id: str, text: str, lang: str, fit_docs: int = 20_000, fit_chars: int = 200_000_000, rounds: int = 1) -> Model:
    """The word model, fitted on a bounded sample of labelled documents (about ``fit_docs``, ``fit_chars`` characters).

    The sample is normalised once and kept as words. First every line counts for its document's label; then,
    ``rounds`` times, for the language the model before gives the line, so that wrong labels and mixed texts lose
    their say. Words are counted in the tasks and combined map-side; the driver gets all counts of the sample, whose
    bound is theirs. A tenth of the sample is held out of the counts: on its lines (of documents in one language that
    their label agrees with) the temperature is chosen that makes the confidence of a line fit how often it is right.
    """
    spark = docs.sparkSession
    sample = _share(docs, doc_id, text, lang, fit_docs, fit_chars)
    tenth = F.pmod(F.xxhash64(doc_id, F.lit("held")), F.lit(10)) == 0

    def normalise(batches):
        for batch in batches:
            cols: list[list] = [[], [], []]
            for t, label, held in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                t = t.as_py()
                if t:
                    for c, x in zip(cols, (label_code(label), held, "\n".join(map(" ".join, line_words(t))))):
                        c.append(x)
            types = (pa.string(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["label", "held", "rows"])

    spread = sample.select(text, lang, tenth).repartition(spark.sparkContext.defaultParallelism)  # a bounded sample
    kept = materialise(spread.mapInArrow(normalise, "label string, held boolean, rows string"), "sample")
    model: Model | None = None
    for _ in range(rounds + 1):
        shared = spark.sparkContext.broadcast(model)

        def count(batches, shared=shared):
            m, by = shared.value, {}
            for batch in batches:
                for code, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                    if m is None and code is None:
                        continue
                    rows = _rows(rows.as_py())
                    tags = [code] * len(rows) if m is None else [m.langs[k] if k >= 0 else None for k in m.score("", rows)[0]]
                    for tag, ws in zip(tags, rows):
                        if tag and ws:
                            by.setdefault(tag, Counter()).update(ws)
            cols = list(zip(*[(tag, w, n) for tag, c in by.items() for w, n in c.items()])) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

        found = kept.where("NOT held").select("label", "rows").mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        model = Model({(r[0], r[1]): float(r[2]) for r in found.collect()})
        shared.destroy()
    model.temperature = _temperature(spark, kept.where("held").select("label", "rows"), model)
    return model


def _rows(text: str) -> list[list[str]]:
    return [line.split(" ") if line else [] for line in text.split("\n")]


def _temperature(spark, held: DataFrame, model: Model) -> float:
    """The temperature of ``HEAT`` under which held-out lines' labels are likeliest; the default where there are none."""
    shared = spark.sparkContext.broadcast(model)

    def losses(batches):
        m, sums = shared.value, np.zeros(len(HEAT))
        for batch in batches:
            for code, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                if code not in m.langs:
                    continue
                tags, em = m.score("", _rows(rows.as_py()))
                k = m.langs.index(code)
                if len(em) and all(t in (-1, k) for t in tags):
                    for i, heat in enumerate(HEAT):
                        z = em / heat
                        z = z - z.max(1, keepdims=True)
                        sums[i] += float((np.log(np.exp(z).sum(1)) - z[:, k]).sum())
        yield pa.RecordBatch.from_arrays([pa.array(HEAT, pa.float64()), pa.array(sums, pa.float64())], names=["heat", "loss"])

    rows = held.mapInArrow(losses, "heat double, loss double").groupBy("heat").agg(F.sum("loss").alias("loss")).where("loss > 0").collect()
    shared.destroy()
    return min(rows, key=lambda r: (r["loss"], r["heat"]))["heat"] if rows else model.temperature


SCHEMA = "seg_no int, lang string, confidence double, chars bigint, first_line int, last_line int, label string, langs int"


def detect_languages(docs: DataFrame, doc_id: str, text: str, lang: str, model: Model) -> DataFrame:
    """``doc_id, seg_no, lang, confidence, chars, first_line, last_line, label, langs``.

    ``seg_no`` 0 is the document: the language most of its characters are in (ties: the earlier in the alphabet).
    ``seg_no`` 1, 2, ... are its segments in reading order: the longest runs of lines in one language; lines
    without language neither form nor break one. ``langs`` counts the document's languages, ``label`` is the code
    its label names (null if none), ``confidence`` of a segment is the share of its language in the
    posterior of all its words, at the calibrated temperature; of a document the share of its characters in the language, weighted so. Null and empty texts and texts without any language
    give no rows; rows with a null id are left out; repeated rows come out repeatedly. One pass over whole
    texts, map-only; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()
    slim = docs.where(F.col(doc_id).isNotNull() & (F.length(text) > 0)).select(doc_id, text, lang)
    names = [doc_id, *[c.split()[0] for c in SCHEMA.split(", ")]]
    types = [pa.int32(), pa.string(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32()]

    def run(batches):
        m = shared.value
        for batch in batches:
            out = [[] for _ in names]
            for d, t, label in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                for row in segments(m, t.as_py()):
                    for c, x in zip(out, (d, *row[:6], label_code(label), row[6])):
                        c.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(out, [batch.schema.field(0).type, *types])], names=names)

    return slim.mapInArrow(run, f"`{doc_id}` {kind}, {SCHEMA}")


def segments(m: Model, text: str):
    """(seg_no, lang, confidence, chars, first_line, last_line, langs) of one text, the document as number 0 first."""
    tags, em = m.score(text)
    if not len(em):
        return
    lines = text.split("\n")
    sizes = [len(x) for x in lines] + [0] * (len(tags) - len(lines))
    chars: dict[int, int] = {}
    runs: list[list] = []  # language, characters, first line, last line, first and last row of scores
    k = 0
    for i, tag in enumerate(tags):
        if tag < 0:
            continue
        chars[tag] = chars.get(tag, 0) + sizes[i]
        if not runs or runs[-1][0] != tag:
            runs.append([tag, 0, i, i, k, k])
        run = runs[-1]
        run[1] += sizes[i]
        run[3], run[5] = i, k
        k += 1
    best = max(sorted(chars), key=chars.__getitem__)
    sure = [_confidence(em[r[4] : r[5] + 1].sum(0), r[0], m.temperature) for r in runs]
    total = sum(chars.values())
    share = sum(c * r[1] for c, r in zip(sure, runs) if r[0] == best) / total
    yield 0, m.langs[best], share, total, runs[0][2], runs[-1][3], len(chars)
    for n, (run, c) in enumerate(zip(runs, sure), 1):
        yield n, m.langs[run[0]], c, run[1], run[2], run[3], len(chars)


def _confidence(logs: np.ndarray, tag: int, temperature: float) -> float:
    p = np.exp(np.maximum((logs - logs.max()) / temperature, -60))
    return float(p[tag] / p.sum())
