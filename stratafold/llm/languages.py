"""Languages of documents and of the paragraphs and spans of mixed ones: script ranges, per-word scores, Viterbi spans.

The script of a word's letters narrows its candidates to the languages that write in it. Each candidate gets a log score from
letter n-grams and whole words, and from how much of the line is neither letter nor blank (log lines, tables and markup are
told by that share, as learned from labelled documents), relative to the best one and floored, so that a name cannot outweigh
a sentence. A Viterbi pass over the words of each paragraph with a penalty for switching labels its spans. A paragraph is in
the language that most of its letters are labelled with, and so is a document; a short quotation is a span of its own and
leaves the paragraph's majority as it is.

The classifier is fitted on the driver on bounded samples: at most ``SAMPLE_ROWS`` rows of known language and, in a second
round, at most ``LABELLED_ROWS`` labelled documents (the first by a hash of their id), each of at most ``LABELLED_CHARS``
characters, of which those paragraphs count whose label the first round confirms. The model that is broadcast is bounded by
these numbers. Confidence is the calibrated chance of being right: a logistic curve over the margin and the number of letters,
fitted on pieces of samples that the model they are scored by has not seen. Every document is labelled whole, where it lies;
nothing is shuffled.

Defined cases. Null texts and texts with fewer than ``LEAST_LETTERS`` letters have no language and give no row; paragraphs
with fewer give no row but keep their number and, in the document's majority, their letters. Letters of a script that no
language of the model writes in have no language and do not count. Scripts without blanks between words are read letter by
letter. Blank paragraphs are not counted. A label is missing if it is null, empty or ``und``; letter case, blanks and a region
after a hyphen do not matter. Ties go to the language first in the model's order. Repeated rows give repeated output. Other
columns are never read. Without any samples of known language there is no model, which is an error. An empty table gives an
empty result.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratafold.functions.jsontext import by_bytes
from stratafold.session import broadcast_object, dealt

LEAST_LETTERS = 20
SAMPLE_ROWS, LABELLED_ROWS, LABELLED_CHARS = 5_000, 2_500, 20_000
SWITCH_PENALTY, WORD_FLOOR, SMOOTHING = 6.0, -5.0, 0.3
#: Upper bounds of the share of a line's characters that are neither letters nor blanks.
FORM_SHARES = (0.2, 0.35)
#: Words by which a language's line forms are drawn to the common ones.
FORM_WORDS = 500
#: Parts that the samples are cut into for calibration, and the words of the pieces scored.
FOLDS, PIECE_WORDS = 4, (2, 4, 8, 16)
#: Words a worker remembers; documents, and bytes of text, labelled at once.
REMEMBERED, TEXTS, TEXT_BYTES = 200_000, 2_000, 4 << 20

#: Scripts that put no blanks between words.
_UNSPACED = r"[\p{Script=Han}\p{Script=Hiragana}\p{Script=Katakana}\p{Script=Thai}\p{Script=Lao}\p{Script=Khmer}\p{Script=Myanmar}]"
_WORD = regex.compile(rf"(?V1)[\p{{L}}&&{_UNSPACED}]\p{{M}}*|[\p{{L}}--{_UNSPACED}][\p{{M}}[\p{{L}}--{_UNSPACED}]]*")
#: The same words where a line has only these signs, of which no letter takes marks or stands in an unspaced script.
_PLAIN_LINE = re.compile("[\x00-\u024f\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u205e]*")
_PLAIN_WORD = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f\u0400-\u0481\u048a-\u04ff]+")
_ASCII_WORD = re.compile("[A-Za-z]+")
_LINE_END = regex.compile(r"\r\n|\r|\n")


def words_of(line: str) -> list[str]:
    return (_ASCII_WORD if line.isascii() else _PLAIN_WORD if _PLAIN_LINE.fullmatch(line) else _WORD).findall(line)


#: Scripts of the letters met so far. A plain dictionary: what a cache decorator wraps would not travel to workers by value.
_SCRIPTS: dict[str, str] = {}


def script_of_letter(letter: str) -> str:
    """The letter's Unicode script, empty for letters that several scripts share.

    The name of a letter begins with that of its script; the property itself decides.
    """
    if letter in _SCRIPTS:
        return _SCRIPTS[letter]
    found = ""
    name = unicodedata.name(letter, "").split()
    for n in range(min(3, len(name)), 0, -1):
        script = "_".join("Han" if w == "CJK" else w.capitalize() for w in name[:n])
        try:
            if regex.fullmatch(rf"\p{{Script={script}}}", letter):
                found = script
                break
        except regex.error:
            continue
    base = unicodedata.normalize("NFKC", letter)
    if not found and len(base) == 1 and base != letter:
        found = script_of_letter(base)
    _SCRIPTS[letter] = found
    return found


def script_of(word: str) -> str:
    """The script of most of a word's letters, the first of those that tie."""
    if word.isascii():
        return "Latin"
    scripts = Counter(s for s in map(script_of_letter, word) if s)
    return scripts.most_common(1)[0][0] if scripts else ""


def form_of(length: int, letters: int, blanks: int) -> int:
    """Class of a line by the share of its characters that are neither letters nor blanks."""
    return bisect.bisect_left(FORM_SHARES, (length - letters - blanks) / length) if length else 0


def paragraphs(text: str) -> list[str]:
    """Paragraphs in order: lines between empty or blank ones."""
    out: list[str] = []
    held: list[str] = []
    for line in [*_LINE_END.split(text), ""]:
        if line.strip():
            held.append(line)
        elif held:
            out.append("\n".join(held))
            held = []
    return out


def features(word: str) -> list[str]:
    bounded = f"^{word}$"
    return [f"={word}", *(bounded[i : i + n] for n in (2, 3, 4) for i in range(len(bounded) - n + 1))]


def without_accents(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


@dataclass
class Model:
    """Log probabilities of features and line forms by language, and the curve that turns margins into confidence."""

    languages: list[str]
    scripts: dict[str, np.ndarray]
    index: dict[str, int]
    weights: np.ndarray
    forms: np.ndarray
    curve: tuple[float, float, float] = (0.0, 2.0, 0.0)

    def word_scores(self, word: str) -> np.ndarray | None:
        """Score of the word in each language, 0 for the best and ``WORD_FLOOR`` at least; None if no language writes in its script."""
        candidates = self.scripts.get(script_of(word))
        if candidates is None:
            return None
        found = features(word)
        unseen = len(self.index)
        got = self.weights[[self.index.get(f, unseen) for f in found]]
        score = np.where(candidates, got.mean(axis=0) * min(len(found), 6), -np.inf)
        return np.maximum(score - score.max(), WORD_FLOOR).astype(np.float32)

    def confidence(self, margin: np.ndarray, letters: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-(a + b * margin + c * np.log1p(letters))))


def fit(samples: Iterable[tuple[str, str]]) -> Model:
    counts: dict[str, Counter] = {}
    forms: dict[str, np.ndarray] = {}
    for language, text in samples:
        own, form = counts.setdefault(language, Counter()), forms.setdefault(language, np.zeros(len(FORM_SHARES) + 1))
        for line in unicodedata.normalize("NFC", text).lower().split("\n"):
            words = words_of(line)
            own.update(words)
            form[form_of(len(line), sum(map(len, words)), line.count(" "))] += len(words)
    in_script: dict[str, Counter] = {}
    by_feature: dict[str, Counter] = {}
    for language, own in counts.items():
        in_script[language], features_of = Counter(), by_feature.setdefault(language, Counter())
        for word, n in own.items():
            in_script[language][script_of(word)] += n
            for f in features(word):
                features_of[f] += n
            plain = without_accents(word)
            if plain != word:
                for f in features(plain):
                    features_of[f] += 0.3 * n
    languages = sorted(counts)
    if not languages:
        raise ValueError("no samples of known language")
    index = {f: i for i, f in enumerate(sorted(set().union(*by_feature.values())))}
    table = np.full((len(index) + 1, len(languages)), SMOOTHING)
    for j, language in enumerate(languages):
        own = by_feature[language]
        table[np.fromiter((index[f] for f in own), np.int64, len(own)), j] += np.fromiter(own.values(), np.float64, len(own))
    # Candidates of a script: the languages that write at least a fifth of their words in it.
    scripts = {}
    for script in set().union(*in_script.values()) - {""}:
        candidates = np.array([in_script[lang][script] >= 0.2 * sum(in_script[lang].values()) for lang in languages])
        if candidates.any():
            scripts[script] = candidates
    # Drawn to the shares of all languages together, so that few words say little.
    form = np.stack([forms[lang] for lang in languages], axis=1)
    form += FORM_WORDS * (form.sum(axis=1, keepdims=True) + 1) / (form.sum() + len(form))
    form = np.log(form / form.sum(axis=0))
    form = np.maximum(form - form.max(axis=1, keepdims=True), WORD_FLOOR)
    return Model(languages, scripts, index, np.log(table / table.sum(axis=0)).astype(np.float32), form.astype(np.float32))


def calibrate(model: Model, samples: list[tuple[str, str]]) -> Model:
    """``model`` with the curve that gives the chance of being right, learned on samples unseen by the model they are scored by."""
    margins, letters, right = [], [], []
    for fold in range(FOLDS):
        rest = [x for i, x in enumerate(samples) if i % FOLDS != fold]
        if not rest:
            continue
        own = fit(rest)
        pieces = []
        for language, text in (x for i, x in enumerate(samples) if i % FOLDS == fold):
            words = text.split()
            pieces += [(language, " ".join(words[:n])) for n in PIECE_WORDS if n < len(words)] + [(language, text)]
        if len(own.languages) < 2 or not pieces:
            continue
        found = Labeller(own).label([t for _, t in pieces])
        margins.append(found.margin)
        letters.append(found.letters.sum(axis=1))
        right.append(np.array([own.languages[int(f.argmax())] == lang for f, (lang, _) in zip(found.letters, pieces)]))
    if not margins:
        return model
    x = np.stack([np.ones(sum(map(len, margins))), np.concatenate(margins), np.log1p(np.concatenate(letters))], axis=1)
    y = np.concatenate(right).astype(np.float64)
    at = np.array([0.0, 1.0, 0.0])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        slope = x.T @ (y - p) - 0.1 * at
        at = at + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), slope)
    return replace(model, curve=tuple(at.tolist()))


class Labelled(NamedTuple):
    """Of each paragraph the letters in each language, the margin of its mean scores and its words; of each word its label, its
    letters and the margin of its score."""

    letters: np.ndarray
    margin: np.ndarray
    sizes: np.ndarray
    label: np.ndarray
    word_letters: np.ndarray
    word_margin: np.ndarray


class Numbers(dict):
    """Numbers of the words met so far; a new word is scored when it is first asked for."""

    def __init__(self, number: Callable[[str], int]) -> None:
        super().__init__()
        self.number = number

    def __missing__(self, word: str) -> int:
        return self.number(word)


class Labeller:
    """Labels the words of many paragraphs at once."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.numbers = Numbers(self._number)
        #: Scores and letters by word number; number 0 stands for every word that no language of the model writes.
        self.scores = [np.zeros(len(self.model.languages), np.float32)]
        self.letters = [0]

    def _number(self, word: str) -> int:
        lower = word.lower()
        n = self.numbers.get(lower)
        if n is None:
            score = self.model.word_scores(lower)
            n = self.numbers[lower] = 0 if score is None else len(self.scores)
            if n:
                self.scores.append(score)
                self.letters.append(len(lower) if lower.isascii() else sum(c.isalpha() for c in lower))
        self.numbers[word] = n
        return n

    def label(self, texts: list[str], margins: bool = False) -> Labelled:
        """``margins`` fills in the words' margins, which only spans need."""
        if len(self.scores) > REMEMBERED:
            self._forget()
        number, languages = self.numbers.__getitem__, len(self.model.languages)
        words: list[int] = []
        forms: list[int] = []
        in_line: list[int] = []
        sizes = []
        for text in texts:
            before = len(words)
            for line in (text if text.isascii() else unicodedata.normalize("NFC", text)).split("\n"):
                own = words_of(line)
                if own:
                    words.extend(map(number, own))
                    forms.append(form_of(len(line), sum(map(len, own)), line.count(" ")))
                    in_line.append(len(own))
            sizes.append(len(words) - before)
        size = np.array(sizes, np.int64)
        found, mean = np.zeros((len(texts), languages)), np.zeros((len(texts), languages))
        label, letters, margin = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words))
        if words:
            at = np.array(words, np.int64)
            letters = np.array(self.letters, np.int64)[at]
            score = np.stack(self.scores)[at] + np.repeat(self.model.forms[forms], in_line, axis=0)
            label = viterbi(score, size)
            place = np.repeat(np.arange(len(texts)), size) * languages + label
            found = np.bincount(place, letters, found.size).reshape(found.shape)
            full = np.flatnonzero(size)
            mean[full] = np.add.reduceat(score, (np.cumsum(size) - size)[full], axis=0) / size[full][:, None]
            if languages > 1 and margins:
                own = score[np.arange(len(label)), label]
                score[np.arange(len(label)), label] = -np.inf
                margin = own - score.max(axis=1)
        if languages == 1:
            return Labelled(found, np.full(len(texts), -WORD_FLOOR), size, label, letters, np.full(len(words), -WORD_FLOOR))
        ordered = np.partition(mean, -2, axis=1)
        return Labelled(found, ordered[:, -1] - ordered[:, -2], size, label, letters, margin)


def viterbi(score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Best label of every word under a penalty for switching; ``sizes`` words of each sequence, one after another."""
    out = np.zeros(len(score), np.int64)
    if not len(score):
        return out
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    active = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), "right")
    best = score[start[: active[0]]].astype(np.float64)
    switched: list[np.ndarray] = []
    sources: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    for t in range(1, len(active)):
        n = active[t]
        if n < len(best):
            ends.append(best[n:])
            best = best[:n]
        source = best.argmax(axis=1)
        jump = best[np.arange(n), source] - SWITCH_PENALTY
        switch = jump[:, None] > best
        best = np.where(switch, jump[:, None], best) + score[start[:n] + t]
        switched.append(switch)
        sources.append(source)
    last = np.concatenate([best, *reversed(ends)]).argmax(axis=1)
    for t in range(len(active) - 1, 0, -1):
        n = active[t]
        out[start[:n] + t] = last[:n]
        back = switched[t - 1][np.arange(n), last[:n]]
        last[:n] = np.where(back, sources[t - 1], last[:n])
    out[start[: active[0]]] = last
    return out


def label_name(label: str | None) -> str:
    """The language a label names, empty if it is missing."""
    name = (label or "").strip().lower().split("-")[0].strip()
    return "" if name == "und" else name


_OUT = "doc_id long, segment int, lang string, confidence double, label string, mixed boolean"
_SPANS = "doc_id long, segment int, span int, first_word int, words int, letters int, lang string, confidence double"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[list[str]], list]]:
    """Keys, paragraphs and labels of a bounded number of documents."""
    for batch in batches:
        for most in by_bytes(batch, 1, TEXT_BYTES):
            for lo in range(0, most.num_rows, TEXTS):
                keys, texts, labels = (c.to_pylist() for c in most.slice(lo, TEXTS).columns)
                yield keys, [paragraphs(t) if t else [] for t in texts], labels


def _label(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    labeller = Labeller(model)
    for keys, pieces, labels in _parts(batches):
        done = labeller.label([p for ps in pieces for p in ps])
        found = done.letters
        totals = found.sum(axis=1)
        sure = model.confidence(done.margin, totals)
        winner = found.argmax(axis=1)
        rows: list[tuple] = []
        at = 0
        for key, label, ps in zip(keys, labels, pieces):
            here = slice(at, at + len(ps))
            at += len(ps)
            letters = found[here].sum(axis=0)
            if letters.sum() < LEAST_LETTERS:
                continue
            own = np.flatnonzero(totals[here] >= LEAST_LETTERS)
            mixed = len(set(winner[here][own].tolist())) > 1
            top = int(letters.argmax())
            weight = totals[here]
            rows.append((key, -1, model.languages[top], float(letters[top] / letters.sum() * (sure[here] * weight).sum() / weight.sum()), label_name(label), mixed))
            for i in own.tolist():
                k = int(winner[here][i])
                rows.append((key, i, model.languages[k], float(found[here][i, k] / weight[i] * sure[here][i]), label_name(label), mixed))
        yield _batch(rows, _OUT)


def _cut(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """The spans of every paragraph: its longest runs of words with one label, those without letters of the model left out."""
    labeller = Labeller(model)
    for keys, pieces, _ in _parts(batches):
        done = labeller.label([p for ps in pieces for p in ps], margins=True)
        if not len(done.label):
            continue
        document = np.repeat(np.arange(len(keys)), [len(ps) for ps in pieces])
        segment = np.concatenate([np.arange(len(ps)) for ps in pieces])
        paragraph = np.repeat(np.arange(len(done.sizes)), done.sizes)
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(done.label) != 0) | (np.diff(paragraph) != 0)]))
        words = np.diff(np.concatenate([starts, [len(done.label)]]))
        letters = np.add.reduceat(done.word_letters, starts)
        sure = model.confidence(np.add.reduceat(done.word_margin, starts) / words, letters)
        own = paragraph[starts]
        first_of = np.concatenate([[0], np.cumsum(np.bincount(document[paragraph], minlength=len(keys)))])
        rows: list[tuple] = []
        last, number = -1, 0
        for i in np.flatnonzero(letters).tolist():
            p = int(own[i])
            number = number + 1 if p == last else 0
            last = p
            d = int(document[p])
            rows.append((keys[d], int(segment[p]), number, int(starts[i] - first_of[d]), int(words[i]), int(letters[i]), model.languages[int(done.label[starts[i]])], float(sure[i])))
        yield _batch(rows, _SPANS)


def train(samples: DataFrame, documents: DataFrame, key: str, text: str, lang: str) -> Model:
    """A model from texts of known language (``lang``, ``text``), refined on labelled documents that it confirms."""
    short = samples.select("lang", "text").dropna().where(F.length("text") <= LABELLED_CHARS)
    known = [(label_name(r[0]), r[1]) for r in short.orderBy(F.xxhash64("text"), "lang").limit(SAMPLE_ROWS).collect()]
    known = [(name, t) for name, t in known if name]
    model = fit(known)
    size = F.length(text)
    labelled = documents.where(F.col(lang).isNotNull() & size.between(2 * LEAST_LETTERS, LABELLED_CHARS)).select(F.col(lang), F.col(text)).orderBy(F.xxhash64(F.col(key))).limit(LABELLED_ROWS).collect()
    labeller = Labeller(model)
    pairs = [(label_name(name), p) for name, t in labelled for p in paragraphs(t) if label_name(name) in model.languages]
    if pairs:
        done = labeller.label([p for _, p in pairs])
        confirmed = [(name, p) for (name, p), letters, m in zip(pairs, done.letters, done.margin) if letters.sum() >= LEAST_LETTERS and model.languages[int(letters.argmax())] == name and letters.max() > 0.9 * letters.sum() and m > 0.3]
        model = fit(known + confirmed)
    return calibrate(model, known)


def segments(documents: DataFrame, key: str, text: str, lang: str, model: Model, partitions: int | None = None) -> DataFrame:
    """``doc_id, segment, lang, confidence, label, mixed``: each document (segment -1) and each of its paragraphs with its
    language; ``label`` is what the document's label names, ``mixed`` whether its paragraphs are in several languages."""
    shared = broadcast_object(documents.sparkSession, model)
    return dealt(documents.select(F.col(key).cast("long"), F.col(text), F.col(lang)), partitions).mapInArrow(lambda batches: _label(batches, shared()), _OUT)


def spans(documents: DataFrame, key: str, text: str, model: Model, partitions: int | None = None) -> DataFrame:
    """``doc_id, segment, span, first_word, words, letters, lang, confidence``: the spans of one language in each paragraph, with
    the position of their first word among the document's words."""
    shared = broadcast_object(documents.sparkSession, model)
    return dealt(documents.select(F.col(key).cast("long"), F.col(text), F.lit(None).cast("string")), partitions).mapInArrow(lambda batches: _cut(batches, shared()), _SPANS)


def relabelled(found: DataFrame) -> DataFrame:
    """Of ``segments``: documents whose label is missing or names another language, and all paragraphs of mixed ones."""
    return found.where(((F.col("segment") == -1) & (F.col("label") != F.col("lang"))) | ((F.col("segment") >= 0) & F.col("mixed"))).select("doc_id", "segment", "lang")
