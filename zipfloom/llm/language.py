"""Language of documents and of their sentences.

A sentence is the average of the embeddings of its words' hashed subwords; a
linear softmax names its language.  The model is trained by stochastic gradient
descent in numpy on a bounded sample of labelled documents, cleaned of labels
that a model of the other half contradicts, and calibrated on held-out
sentences; a sentence below the calibrated confidence has no language.
"""

from __future__ import annotations

import html
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled documents that the model is fitted on, at most; longest text of one, in characters.
TRAIN_DOCS, TRAIN_CHARS = 1_500, 100_000
BUCKETS, WIDTH, EPOCHS, RATE, BATCH, NGRAMS = 1 << 15, 16, 2, 0.1, 32, (2, 3, 4)
#: Held-out share, largest error of accepted held-out sentences, least confidence.
HELD_OUT, MAX_ERROR, LEAST_CONFIDENCE = 0.15, 0.002, 0.6
#: Words whose scores a worker keeps; fewest words of a sentence.
KEPT_WORDS, LEAST_WORDS = 300_000, 2

# How labels spell the languages (ISO 639-1, 639-2 B and T, English and own names).
SPELLINGS = {
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "en": ["en", "eng", "english"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "it": ["it", "ita", "italian", "italiano"],
    "nl": ["nl", "nld", "dut", "dutch", "nederlands"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "ru": ["ru", "rus", "russian", "русский"],
}
_BY_SPELLING = {s: code for code, all_ in SPELLINGS.items() for s in all_}

_END = regex.compile(r"[.!?…]+[\"'”»’)\]]*(?=\s|$|<)|[。！？؟।]+[\"'”»’)\]」』]*|\n")
_WORD = regex.compile(r"(?<![\w=#@/\\])\p{L}[\p{L}\p{M}]*(?:['’-]\p{L}[\p{L}\p{M}]*)*(?![\w=])")
_MARKUP = regex.compile(r"<[^<>\n]+>|\{[^{}\n]+\}")
_QUOTED = regex.compile(r"“[^“”\n]+”|«[^«»\n]+»|„[^„“”\n]+[“”]|‘[^‘’\n]+’")


def label_language(label: str | None) -> str | None:
    """The two-letter code that a label means, however it spells it, or None.

    Case, outer blanks and a region (``en_US``, ``pt-BR``) don't matter.
    """
    if label is None:
        return None
    s = unicodedata.normalize("NFC", label).strip().lower()
    return _BY_SPELLING.get(s) or _BY_SPELLING.get(regex.split(r"[-_. (]", s, maxsplit=1)[0])


def split_sentences(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, whole) of each stretch up to an end mark or line end.

    ``whole``: it ends with an end mark, so that it is a sentence, not a code.
    """
    out, lo = [], 0
    for m in _END.finditer(text):
        if text[lo : m.end()].strip():
            out.append((lo, m.end(), m.group()[0] != "\n"))
        lo = m.end()
    if text[lo:].strip():
        out.append((lo, len(text), False))
    return out


def words_of(sentence: str) -> list[str]:
    """Lower-case words without markup, codes and quoted insertions.

    A sentence that is quoted as a whole keeps its words.
    """
    s = _MARKUP.sub(" ", sentence) if "<" in sentence or "{" in sentence else sentence
    if "&" in s:
        s = html.unescape(s)
    s = s.lower()
    if s.isascii():  # nothing to compose, no such quotes
        return _WORD.findall(s)
    s = unicodedata.normalize("NFC", s)
    return _WORD.findall(_QUOTED.sub(" ", s)) or _WORD.findall(s)


def subwords(word: str, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the word and of its n-grams with ends marked."""
    s = f"<{word}>"
    grams = [s, *(s[i : i + n] for n in NGRAMS for i in range(len(s) - n + 1))]
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in grams]


@dataclass
class Model:
    """Class scores of every bucket, and the calibration. Arrays of fixed size."""

    languages: list[str]
    scores: np.ndarray = field(repr=False)
    bias: np.ndarray = field(repr=False)
    temperature: float = 1.0
    threshold: float = LEAST_CONFIDENCE


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _flat(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(b) for b in bags])
    return np.concatenate(bags), np.repeat(np.arange(len(bags)), sizes)


def _logits(bags: list[np.ndarray], table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    out = np.empty((len(bags), len(bias)))
    for lo in range(0, len(bags), 2048):
        part = bags[lo : lo + 2048]
        f, _ = _flat(part)
        starts = np.cumsum([0, *[len(b) for b in part[:-1]]])
        out[lo : lo + 2048] = np.add.reduceat(table[f], starts, axis=0) / np.array([len(b) for b in part])[:, None] + bias
    return out


def _sgd(bags: list[np.ndarray], y: np.ndarray, classes: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Class scores per bucket after stochastic gradient descent.

    Steps are scaled by the root of summed squared gradients (AdaGrad), one
    scale per bucket, so rare subwords learn as fast as frequent ones.
    """
    emb = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out = rng.uniform(-1 / WIDTH, 1 / WIDTH, (classes, WIDTH)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    seen, seen_out, seen_bias = np.full(BUCKETS, 1e-8, np.float32), np.full_like(out, 1e-8), np.full_like(bias, 1e-8)
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), BATCH):
            ids = order[lo : lo + BATCH]
            part = [bags[i] for i in ids]
            f, owner = _flat(part)
            n = np.array([len(b) for b in part], np.float32)[:, None]
            h = np.add.reduceat(emb[f], np.r_[0, np.cumsum(n[:-1, 0])].astype(int), axis=0) / n
            g = _softmax(h @ out.T + bias).astype(np.float32)
            g[np.arange(len(ids)), y[ids]] -= 1
            back = (g @ out) / n
            step, step_bias = g.T @ h, g.sum(axis=0)
            seen_out += step**2
            seen_bias += step_bias**2
            out -= RATE * step / np.sqrt(seen_out)
            bias -= RATE * step_bias / np.sqrt(seen_bias)
            by = np.argsort(f, kind="stable")
            fs = f[by]
            head = np.flatnonzero(np.r_[True, fs[1:] != fs[:-1]])
            own, moved = fs[head], np.add.reduceat(back[owner[by]], head, axis=0)
            seen[own] += (moved**2).mean(axis=1)
            emb[own] -= RATE * moved / np.sqrt(seen[own])[:, None]
    return emb @ out.T, bias


def _calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Temperature of the least loss; the least threshold with few errors above it."""
    grid = [1.0, 1.5, 2.0, 3.0, 5.0]
    loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    t = grid[int(np.argmin(loss))]
    p = _softmax(z / t)
    conf, wrong = p.max(axis=1), p.argmax(axis=1) != y
    order = np.argsort(-conf, kind="stable")
    error = np.cumsum(wrong[order]) / np.arange(1, len(y) + 1)
    fine = np.flatnonzero(error <= MAX_ERROR)
    if len(fine) and fine[-1] == len(y) - 1:  # nothing has to be rejected
        return t, LEAST_CONFIDENCE
    lowest = float(conf[order][fine[-1]]) if len(fine) else 0.99
    return t, min(max(lowest, LEAST_CONFIDENCE), 0.99)


def _plain(word: str) -> str:
    """The word without accents, as damaged texts have it."""
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def fit(texts: list[tuple[str, str]], seed: int = 0) -> Model | None:
    """Fit on (text, two-letter label) rows; None if they name fewer than two languages."""
    rows, half = [], []
    for n, (text, lang) in enumerate(texts):
        for a, b, whole in split_sentences(text):
            w = words_of(text[a:b])
            if whole and len(w) >= LEAST_WORDS:
                rows.append((w, lang))
                half.append(n % 2)
    languages = sorted({lang for _, lang in rows})
    if len(languages) < 2:
        return None
    at = {lang: i for i, lang in enumerate(languages)}
    y = np.array([at[lang] for _, lang in rows])
    known: dict[str, list[int]] = {}

    def bag(words: list[str]) -> np.ndarray:
        for w in words:
            if w not in known:
                known[w] = subwords(w)
        return np.array([f for w in words for f in known[w]])

    bags = [bag(w) for w, _ in rows]
    rng = np.random.default_rng(seed)
    # each half's labels are judged by a model of the other half, which can't have learnt their errors
    half_of, doubted = np.array(half), np.zeros(len(rows), bool)
    for h in (0, 1):
        own, other = np.flatnonzero(half_of == h), np.flatnonzero(half_of != h)
        if len(own) and len(other):
            table, bias = _sgd([bags[i] for i in other], y[other], len(languages), rng)
            p = _softmax(_logits([bags[i] for i in own], table, bias))
            doubted[own] = (p.argmax(axis=1) != y[own]) & (p.max(axis=1) >= 0.5)
    keep = np.flatnonzero(~doubted)
    test = rng.random(len(keep)) < HELD_OUT
    train, held = keep[~test], keep[test]
    if not len(train) or not len(held):
        table, bias = _sgd(bags, y, len(languages), rng)
        return Model(languages, table.astype(np.float32), bias)
    plain = [i for i in train if any(_plain(w) != w for w in rows[i][0])]
    more = [bag([_plain(w) for w in rows[i][0]]) for i in plain]
    table, bias = _sgd([*[bags[i] for i in train], *more], np.r_[y[train], y[plain]].astype(int), len(languages), rng)
    t, threshold = _calibrate(_logits([bags[i] for i in held], table, bias), y[held])
    return Model(languages, table.astype(np.float32), bias, t, threshold)


class Namer:
    """Names sentences; keeps the summed scores of words that it has met."""

    def __init__(self, model: Model):
        self.m = model
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.sums = np.empty((0, len(self.m.languages)), np.float64)
        self.count = np.empty(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        bags = [np.array(subwords(w)) for w in words]
        f, _ = _flat(bags)
        sizes = np.array([len(b) for b in bags])
        sums = np.add.reduceat(self.m.scores[f].astype(np.float64), np.cumsum(sizes) - sizes, axis=0)
        self.index.update(zip(words, range(len(self.count), len(self.count) + len(words))))
        self.sums, self.count = np.concatenate([self.sums, sums]), np.concatenate([self.count, sizes])

    def name(self, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Class and confidence of each sentence (lists of words, none empty)."""
        if len(self.index) > KEPT_WORDS:
            self._reset()
        fresh = list({w for s in sentences for w in s if w not in self.index})
        if fresh:
            self._learn(fresh)
        which = np.fromiter((self.index[w] for s in sentences for w in s), np.int64)
        starts = np.cumsum([0, *[len(s) for s in sentences[:-1]]])
        z = np.add.reduceat(self.sums[which], starts, axis=0) / np.add.reduceat(self.count[which], starts)[:, None]
        p = _softmax((z + self.m.bias) / self.m.temperature)
        return p.argmax(axis=1), p.max(axis=1)


class Stretch(NamedTuple):
    """Text up to an end mark or line end; ``whole``: a sentence of several words."""

    start: int
    end: int
    lang: str | None = None
    guess: str | None = None
    confidence: float = 0.0
    whole: bool = False
    words: int = 0


def named_sentences(namer: Namer | None, texts: list[str | None], every: bool = True) -> list[list[Stretch]]:
    """The stretches of each text, named wherever they hold a word; without ``every``, whole sentences only.

    ``guess`` is the likeliest language, ``lang`` the same unless its confidence
    is below the calibrated one; headlines, list items and lines of chat are
    named as sentences are, codes have no words and no language.
    """
    spans = [split_sentences(t) if t else [] for t in texts]
    words, where = [], []
    out: list[list[Stretch]] = [[] for _ in texts]
    for i, (t, s) in enumerate(zip(texts, spans)):
        for a, b, ended in s:
            w = words_of(t[a:b]) if every or ended else []
            if w and (every or len(w) >= LEAST_WORDS):
                words.append(w)
                where.append((i, len(out[i])))
            out[i].append(Stretch(a, b, whole=ended and len(w) >= LEAST_WORDS, words=len(w)))
    if namer is not None and words:
        cls, conf = namer.name(words)
        for (i, k), c, p in zip(where, cls.tolist(), conf.tolist()):
            name = namer.m.languages[c]
            out[i][k] = out[i][k]._replace(lang=name if p >= namer.m.threshold else None, guess=name, confidence=p)
    return out


_STRETCHES = "array<struct<start:int,end:int,lang:string,guess:string,confidence:double>>"
_DOC = (
    f"doc_id bigint, label string, label_lang string, lang string, guess string, confidence double, langs array<string>, "
    f"status string, stretches {_STRETCHES}"
)


def _stretches(sentences: list[Stretch]) -> list[tuple]:
    """Neighbouring stretches of one language as one; what holds no word, or too few to tell, joins what precedes."""
    out: list[list] = []
    for s in sentences:
        told = s.guess is not None and (s.whole or s.lang is not None and s.words >= LEAST_WORDS)
        if out and (not told or (out[-1][4] and out[-1][2] == s.lang)):
            out[-1][1] = s.end
            if told:
                out[-1][4].append(s)
        elif out and not out[-1][4]:  # only codes so far
            out[-1][1:] = [s.end, s.lang, None, [s]]
        else:
            out.append([s.start, s.end, s.lang, None, [s] if told else []])
    return [
        (a, b, lang, max(s, key=lambda x: x.confidence).guess if s else None, float(np.mean([x.confidence for x in s])) if s else 0.0)
        for a, b, lang, _, s in out
    ]


def _mass(sentences: list[Stretch], name: str) -> dict[str, float]:
    mass: dict[str, float] = {}
    for s in sentences:
        if lang := getattr(s, name):
            mass[lang] = mass.get(lang, 0.0) + (s.end - s.start) * s.confidence
    return mass


def _documents(shared, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        namer = Namer(model) if model else None
        span = [("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("guess", pa.string()), ("confidence", pa.float64())]
        kinds = [*[pa.string()] * 4, pa.float64(), pa.list_(pa.string()), pa.string(), pa.list_(pa.struct(span))]
        names = ["doc_id", "label", "label_lang", "lang", "guess", "confidence", "langs", "status", "stretches"]
        keys = [n for n, _ in span]
        for batch in batches:
            labels, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            cols: list[list] = [[] for _ in kinds]
            for label, sentences in zip(labels, named_sentences(namer, texts, every)):
                own = label_language(label)
                whole = [s for s in sentences if s.whole]
                langs = sorted(_mass(whole, "lang"))
                # sentences name the document; where none is sure, whatever holds words does
                told = whole if langs else [s for s in sentences if s.guess]
                sure, any_ = _mass(told, "lang"), _mass(told, "guess")
                lang, guess = max(sorted(sure), key=sure.get, default=None), max(sorted(any_), key=any_.get, default=None)
                size = sum(s.end - s.start for s in told)
                status = (
                    "no_sentence" if not whole else "unsure" if not langs else "mixed" if len(langs) > 1
                    else "missing" if own is None else "wrong" if own != lang else "right"
                )
                stretches = [dict(zip(keys, s)) for s in _stretches(sentences)] if every else None
                conf = (sure[lang] if lang else any_[guess]) / size if guess else None
                for c, v in zip(cols, (label, own, lang, lang or guess, conf, langs, status, stretches)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=names)

    return run


def train(docs: DataFrame, limit: int = TRAIN_DOCS, seed: int = 0) -> Model | None:
    """Fit on at most ``limit`` labelled documents, those with the least hashes.

    Texts longer than TRAIN_CHARS aren't drawn, so the sample's size is bounded.
    Hashes above a bound that follows from the count drop out before the sort,
    so that it holds about twice the sample, however many documents there are.
    The sample isn't evened out over languages: wrong labels are spread evenly,
    so they would make up much of what a rare language is given.
    """
    labelled = docs.where("lang is not null and text is not null and doc_id is not null").select("doc_id", "lang", "text")
    labelled = labelled.where(F.length("text") <= TRAIN_CHARS)
    n = labelled.count()
    hashed = labelled.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id"))
    if n > 2 * limit:
        hashed = hashed.where(F.pmod("_h", F.lit(1_000_000)) < max(1, 2_000_000 * limit // n))
    got = hashed.orderBy("_h", "doc_id").limit(limit).collect()
    return fit([(r["text"], code) for r in got if (code := label_language(r["lang"]))], seed)


def name_languages(docs: DataFrame, model: Model | None, every: bool = True) -> DataFrame:
    """Language and confidence of every document and of its stretches.

    ``docs`` has ``doc_id, lang, text``.  Result, one row per row: ``doc_id,
    label, label_lang`` (what the label means), ``lang`` (of most of the text;
    null where the calibrated confidence isn't reached), ``guess`` (the
    likeliest language of any text with words), ``confidence``, ``langs`` (all
    that fill a whole sentence), ``status`` and ``stretches`` (start, end, lang,
    guess, confidence).  Texts without whole sentences are named by what words
    they have.  status is ``no_sentence`` (null and empty texts, codes, headlines), ``unsure`` (all sentences rejected),
    ``mixed``, ``missing`` (the label names no language), ``wrong`` or ``right``.
    Without ``every`` only whole sentences are named, which is all that
    :func:`label_cases` asks for, and ``stretches`` is null.  Without a model nothing is named.  Whole texts are read, whatever their
    length.  A narrow map; the model is broadcast, its size is fixed.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = docs.select(F.col("doc_id").cast("bigint"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return src.mapInArrow(_documents(shared, every), _DOC)


def label_cases(named: DataFrame) -> DataFrame:
    """``doc_id, lang``: a row per language of each document whose label is missing, wrong or not all."""
    cases = named.where(F.col("status").isin("mixed", "missing", "wrong"))
    return cases.select("doc_id", F.explode("langs").alias("lang")).distinct()
