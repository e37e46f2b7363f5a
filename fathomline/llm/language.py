"""Languages of documents and of their stretches, whatever their labels say.

Hierarchical discrimination: linear support vector machines, one for each
family against the rest, decide the family of a sentence (Han, Germanic, Romance); within it
one machine for each pair of languages votes. Features are letter n-grams
within words, so a sentence's score is the mean of its words' scores, and the
tasks that read the texts keep the scores of the words they met.

``train`` fits the machines on the driver from a bounded sample: the clean
reference sentences and about ``SAMPLE_DOCS`` labelled documents of each
language of at most ``SAMPLE_CHARS`` characters, of which only those sentences are
used that a first model agrees on with the label. A part of the sampled
documents is held out of the fit and turns margins into confidences.
``stored`` fits once in a session and keeps the model in the shared folder.
Everything else covers all documents and is done where they are read, whole:
only languages leave a scan, and nothing is shuffled.

Headings, log lines, code, quoted sentences and unfinished lines are no
sentences. A document has a language if two consecutive sentences are in it, or its
only sentence.

Defined cases: null, empty and blank texts and texts without sentences have no
language; a label counts in any usual spelling, and as missing if it is null,
blank or means none of the languages; repeated rows are judged each; texts of
any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from hashlib import sha1
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.text import strip
from fathomline.llm.batches import slices
from fathomline.session import shared_dir, spread

FAMILIES = {"han": ("zh",), "germanic": ("en", "de", "nl"), "romance": ("fr", "es", "pt")}
LANGUAGES = tuple(x for xs in FAMILIES.values() for x in xs)
PAIRS = tuple((a, b) for xs in FAMILIES.values() for i, a in enumerate(xs) for b in xs[i + 1 :])
#: Usual spellings of labels, without region or script (fixed values).
SPELLINGS = {
    "en": ("en", "eng", "english"),
    "zh": ("zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文", "汉语", "漢語", "华语", "普通话", "简体中文", "繁體中文"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français", "francais"),
    "es": ("es", "spa", "spanish", "español", "espanol", "castellano"),
    "pt": ("pt", "por", "portuguese", "português", "portugues"),
    "nl": ("nl", "nld", "dut", "dutch", "nederlands", "flemish", "vlaams"),
}

#: Bounds of the training sample: documents of each label and their length, and sentences of each language.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_SENTENCES = 300, 20_000, 1000
#: One of so many sampled documents is held out to measure confidences on.
HELD_OUT = 5
#: Weights of a machine; words whose scores a task keeps.
BUCKETS, KNOWN_WORDS = 1 << 16, 300_000

# --- sentences ---------------------------------------------------------------

_BREAK = "\x00"
_NO_PROSE = re.compile(
    r"^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\Z)"  # fenced code
    r"|^(?:[^\n]*\s)?#{1,6}[ \t][^\n]*"  # headings, also behind stray characters
    r"|^[ \t]*>[^\n]*"  # quotes
    r"|^[ \t]*[\[{][\"{\[][^\n]*"  # records
    r"|^[ \t]*\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d[^\n]*"  # log lines
    r"|^[ \t]*(?:\d+\. |at )\S*[/\\.]\S*:\d+[^\n]*"  # stack lines
    r"|[\"“«「][^\"”»」\n]{8,}[.!?。！？][\"”»」]",  # single quoted sentences
    re.M | re.S,
)
_STOP = "[.!?]+[\"'”’)\\]]*(?=\\s|\\Z|\x00)|[。！？]+[\"”’」』）]*"
_END = re.compile(f"(?:{_STOP})|\x00+")
_WORD = re.compile(r"[A-Za-zÀ-ɏ]+(?:[-_'’0-9][A-Za-z0-9À-ɏ]*)*|[㐀-鿿豈-﫿]+")
_TECHNICAL = re.compile(r"[-_0-9]")


def sentences(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence of prose: what stands between two ends, if it is ended itself."""
    plain = text.replace("\r", "\n")
    plain = _NO_PROSE.sub(lambda m: _BREAK * len(m.group()), plain)
    out, start = [], 0
    for m in _END.finditer(plain):
        end = m.end()
        if plain[m.start()] != _BREAK:
            out.append((start, end))
        start = end
    return out


def _is_sentence(words: list[str]) -> bool:
    return len(words) >= 3 or any(w[0] >= "㐀" and len(w) >= 3 for w in words)


# --- features ----------------------------------------------------------------


def _folded(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


def _features(word: str) -> list[int]:
    """The buckets of a lower-case word's n-grams, of itself, and of itself without accents."""
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in (1, 2, 3, 4) for i in range(len(marked) - n + 1)]
    grams += [f"={word}"] * 2 + [f"~{_folded(word)}"] * 2
    return [zlib.crc32(g.encode()) % (BUCKETS - 1) + 1 for g in grams]


#: The bucket of Han characters, whichever they are.
_HAN = 0


def _weight(word: str) -> float:
    """How much a word counts: Han characters half a word each, names of services and numbers nothing."""
    if word[0] >= "㐀":
        return len(word) / 2
    return 0.0 if _TECHNICAL.search(word) else 1.0


class Sentences:
    """Sentences as numbers of words, and the words' features, for fitting."""

    def __init__(self, sentences: list[list[str]]):
        self.known: dict[str, int] = {}
        words: list[int] = []
        sizes: list[int] = []
        for sentence in sentences:
            before = len(words)
            words += [self.known.setdefault(w, len(self.known)) for w in sentence if _weight(w)]
            sizes.append(len(words) - before)
        self.weight = np.array([_weight(w) for w in self.known])
        features = [[_HAN] if w[0] >= "\u3400" else _features(w.lower()) for w in self.known]
        self.feature_word = np.repeat(np.arange(len(features)), [len(f) for f in features])
        used, self.feature = np.unique(np.fromiter((b for f in features for b in f), np.int64), return_inverse=True)
        self.buckets = used
        self.feature_value = 1 / np.array([len(f) for f in features])[self.feature_word]
        self.word = np.array(words, np.int64)
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        total = np.bincount(self.owner, self.weight[self.word], len(sizes))
        self.total = np.maximum(total, 1e-9)
        self.told = total > 0

    def scores(self, by_bucket: np.ndarray) -> np.ndarray:
        """The mean score of each sentence's words; ``by_bucket`` has the weights of the used buckets."""
        by_word = np.bincount(self.feature_word, self.feature_value * by_bucket[self.feature], len(self.weight)) * self.weight
        return np.bincount(self.owner, by_word[self.word], len(self.total)) / self.total

    def pulled(self, pull: np.ndarray) -> np.ndarray:
        """What the sentences' pulls come to in each used bucket."""
        by_word = np.bincount(self.word, (pull / self.total)[self.owner], len(self.weight)) * self.weight
        return np.bincount(self.feature, self.feature_value * by_word[self.feature_word], len(self.buckets))


# --- machines ----------------------------------------------------------------


#: Brings the mean of words' vectors to about unit length.
_LENGTH = 3.0


def fit_machine(rows: Sentences, sign: np.ndarray, ridge: float = 1e-4, rounds: int = 200) -> np.ndarray:
    """The weights of a linear machine with squared hinge loss, by accelerated gradients over all rows of sign 1 or -1."""
    share = np.zeros(len(sign))
    for side in (1, -1):
        share[sign == side] = 0.5 / max((sign == side).sum(), 1)
    w = previous = np.zeros(len(rows.buckets))
    for k in range(rounds):
        ahead = w + k / (k + 3) * (w - previous)
        slack = np.maximum(0, 1 - sign * _LENGTH * rows.scores(ahead))
        pull = rows.pulled(_LENGTH * share * sign * slack)
        previous, w = w, ahead - 0.45 * (2 * ridge * ahead - 2 * pull)
    out = np.zeros(BUCKETS, np.float32)
    out[rows.buckets] = w
    return out


class Model:
    """The machines of all families and pairs, as columns of one table of weights.

    ``sure`` is the slope and offset that turn a margin into a confidence.
    """

    def __init__(self, weights: np.ndarray, scale: np.ndarray, sure: tuple[float, float] = (2.5, 0.0)):
        self.weights, self.scale, self.sure = weights, scale, sure

    @classmethod
    def fit(cls, examples: list[tuple[str, list[str]]]) -> Model:
        """From (language, words) of sentences."""
        rows = Sentences([words for _, words in examples])
        langs = np.array([LANGUAGES.index(lang) for lang, _ in examples])
        machines = []
        for members in FAMILIES.values():
            own = np.isin(langs, [LANGUAGES.index(x) for x in members])
            machines.append(fit_machine(rows, np.where(own, 1, -1)))
        for a, b in PAIRS:
            sign = (langs == LANGUAGES.index(a)).astype(int) - (langs == LANGUAGES.index(b))
            machines.append(fit_machine(rows, sign))
        weights = np.stack(machines, axis=1)
        scale = [np.median(np.abs(rows.scores(weights[rows.buckets, c]))) for c in range(weights.shape[1])]
        return cls(weights, np.maximum(scale, 1e-9).astype(np.float32))

    def scores(self, rows: Sentences) -> np.ndarray:
        return np.stack([rows.scores(self.weights[rows.buckets, c]) for c in range(self.weights.shape[1])], axis=1)

    def judge(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and confidence for each row of mean scores."""
        best, margin = self.margins(scores)
        slope, offset = self.sure
        return best, 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))

    def calibrated(self, scores: np.ndarray, truth: np.ndarray) -> Model:
        """The model with the slope and offset that fit held-out sentences best, by Newton's method on the log loss.

        Targets are moved in from 0 and 1 by the size of the sample, so that a
        sample without errors gives finite numbers.
        """
        best, margin = self.margins(scores)
        right = best == truth
        if not len(right):
            return self
        target = np.where(right, (right.sum() + 1) / (right.sum() + 2), 1 / ((~right).sum() + 2))
        x = np.stack([margin, np.ones(len(margin))], axis=1)
        at = np.array(self.sure)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
            bend = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            at = at + np.clip(np.linalg.solve(bend, x.T @ (target - p)), -1, 1)
        # more margin never means less confidence
        return Model(self.weights, self.scale, (max(float(at[0]), 0.1), float(at[1])))

    def margins(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language number and its scaled margin for each row of mean scores."""
        scaled = scores / self.scale
        n = len(FAMILIES)
        family = scaled[:, :n].argmax(axis=1)
        two = np.sort(scaled[:, :n], axis=1)[:, -2:]
        sure = two[:, 1] - two[:, 0]
        best = np.zeros(len(scores), np.int64)
        for number, members in enumerate(FAMILIES.values()):
            own = np.flatnonzero(family == number)
            margin = np.full((len(own), len(members), len(members)), np.inf)
            for column, (a, b) in enumerate(PAIRS, n):
                if a in members:
                    i, j = members.index(a), members.index(b)
                    margin[:, i, j], margin[:, j, i] = scaled[own, column], -scaled[own, column]
            # each machine has a vote; of equal votes the smallest margin decides
            votes = (margin > 0).sum(axis=2) + 0.5 * np.tanh(margin.min(axis=2))
            won = votes.argmax(axis=1)
            best[own] = np.array([LANGUAGES.index(x) for x in members])[won]
            sure[own] = np.minimum(sure[own], margin[np.arange(len(own)), won].min(axis=1))
        return best, sure


class Judge:
    """Judges texts with a model and remembers the scores of words. One for each task."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, self.model.weights.shape[1]), np.float32)
        self.counts = np.zeros(1024, np.float32)

    def _number(self, word: str) -> int:
        n = len(self.known)
        if n == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        weight = _weight(word)
        if weight:
            buckets = [_HAN] if word[0] >= "㐀" else _features(word.lower())
            self.table[n] = self.model.weights[buckets].mean(axis=0) * weight
        self.counts[n] = weight
        self.known[word] = n
        return n

    def texts(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int, int]]]:
        """For each text its stretches: language, confidence, start, end and number of sentences."""
        owner, spans, words, ends = [], [], [], []
        known, number = self.known, self._number
        for i, text in enumerate(texts):
            for a, b in sentences(text) if text else ():
                found = _WORD.findall(text, a, b)
                if _is_sentence(found):
                    owner.append(i)
                    spans.append((a, b))
                    words += [known[w] if w in known else number(w) for w in found]
                    ends.append(len(words))
        out: list[list[tuple[str, float, int, int, int]]] = [[] for _ in texts]
        if owner:
            at = np.array(words)
            first = np.array([0, *ends[:-1]])
            sums = np.add.reduceat(self.table[at], first, axis=0)
            weight = np.add.reduceat(self.counts[at], first)
            told = weight > 0
            best, _ = self.model.judge(sums / np.maximum(weight, 1e-9)[:, None])
            self._stretches(texts, out, np.array(owner), spans, sums, weight, np.where(told, best, -1))
        if len(known) > KNOWN_WORDS:
            self._forget()
        return out

    def _stretches(self, texts, out, owner, spans, sums, weight, best) -> None:
        keep = best >= 0
        index = np.flatnonzero(keep)
        if not len(index):
            return
        owner, best, sums, weight = owner[index], best[index], sums[index], weight[index]
        per_text = np.bincount(owner)
        first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (best[1:] != best[:-1])))
        sizes = np.diff(np.append(first, len(owner)))
        mean = np.add.reduceat(sums, first, axis=0) / np.add.reduceat(weight, first)[:, None]
        _, sure = self.model.judge(mean)
        for f, n, confidence in zip(first, sizes, sure, strict=True):
            if n >= 2 or per_text[owner[f]] == 1:
                start, end = spans[index[f]][0], spans[index[f + n - 1]][1]
                text = texts[owner[f]]
                while text[start].isspace():
                    start += 1
                out[owner[f]].append((LANGUAGES[best[f]], float(confidence), start, end, int(n)))


# --- training ----------------------------------------------------------------


def label_of(c: Column) -> Column:
    """The language that a label means, or null."""
    folded = F.regexp_extract(F.lower(strip(c)), r"^([\p{L}]+)", 1)
    out = F.lit(None).cast("string")
    for lang, spellings in SPELLINGS.items():
        out = F.when(folded.isin(*spellings), F.lit(lang)).otherwise(out)
    return out


def _examples(rows: Iterable[tuple[str, str | None]]) -> tuple[list[tuple[str, list[str]]], list[int]]:
    """Label and words of each sentence, and the number of its text."""
    out, owner = [], []
    for i, (lang, text) in enumerate(rows):
        for a, b in sentences(text or ""):
            words = _WORD.findall(text, a, b)
            if _is_sentence(words):
                out.append((lang, words))
                owner.append(i)
    return out, owner


def _agreed(model: Model, found: list[tuple[str, list[str]]], owner: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Which sentences' own languages, by the model, are what their text's label says, and which sentences' neighbours' are."""
    best, _ = model.judge(model.scores(Sentences([words for _, words in found])))
    right = np.array([LANGUAGES[b] == lang for b, (lang, _) in zip(best, found, strict=True)])
    text = np.array(owner)
    near, beside = np.zeros(len(text)), np.zeros(len(text))
    for step in (-2, -1, 1, 2):
        same = np.zeros(len(text), bool)
        if step > 0:
            same[:-step] = text[:-step] == text[step:]
        else:
            same[-step:] = text[-step:] == text[:step]
        near += same
        beside += same * np.roll(right, -step)
    return right, (near > 1) & (beside >= 0.75 * near)


def _bounded(examples: list[tuple[str, list[str]]], most: int) -> list[tuple[str, list[str]]]:
    """At most so many of each language, spread over all."""
    out = []
    for lang in LANGUAGES:
        own = [x for x in examples if x[0] == lang]
        out += own if len(own) <= most else [own[i * len(own) // most] for i in range(most)]
    return out


def _sample(
    docs: DataFrame, reference: DataFrame, docs_each: int, chars: int, sentences_each: int
) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """Label and text of the reference sentences and of the sampled documents, each by the smallest hashes."""
    references = reference.select(label_of(F.col("lang")).alias("lang"), "text").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= chars)
    )
    clean = references.orderBy(F.xxhash64("text"), "text").limit(sentences_each * len(LANGUAGES)).collect()
    labelled = docs.select("doc_id", label_of(F.col("lang")).alias("lang")).where(F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("label") == lang, F.lit(min(1.0, docs_each / n))).otherwise(share)
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = (
        docs.select("doc_id", label_of(F.col("lang")).alias("label"), "text")
        .where(F.col("text").isNotNull() & (hashed < share) & (F.length("text") <= chars))
        .orderBy(hashed, "doc_id", "text")
        .limit(2 * docs_each * len(LANGUAGES))
        .collect()
    )
    return [(r["lang"], r["text"]) for r in clean], [(r["label"], r["text"]) for r in sample]


def train(
    docs: DataFrame,
    reference: DataFrame,
    sample_docs: int = SAMPLE_DOCS,
    sample_sentences: int = SAMPLE_SENTENCES,
    sample_chars: int = SAMPLE_CHARS,
) -> Model:
    """Fit the machines on a bounded sample, and their confidences on the part of it that is held out.

    The driver sees the reference sentences, ``sample_sentences`` a language at
    most, and about ``sample_docs`` documents of each label; documents of more than
    ``sample_chars`` characters are no part of the sample.
    """
    clean, rows = _sample(docs, reference, sample_docs, sample_chars, sample_sentences)
    seeds = [(lang, _WORD.findall(text)) for lang, text in clean]
    if len({lang for lang, _ in seeds}) < 2:
        raise ValueError("reference sentences of at least two languages are needed")
    held = [i % HELD_OUT == 0 for i in range(len(rows))]
    found, owner = _examples([r for r, h in zip(rows, held, strict=True) if not h])
    apart, apart_owner = _examples([r for r, h in zip(rows, held, strict=True) if h])
    model = Model.fit(_bounded(seeds, sample_sentences))
    for _ in range(2 if found else 0):
        own, beside = _agreed(model, found, owner)
        agreed = [x for x, k in zip(found, own | beside, strict=True) if k]
        model = Model.fit(_bounded(agreed, sample_sentences) + seeds)
    if not apart:
        return model
    # a held-out sentence's language is what its label and its neighbours say, whatever it looks like itself
    _, beside = _agreed(model, apart, apart_owner)
    truth = np.array([LANGUAGES.index(lang) for lang, _ in apart])
    return model.calibrated(model.scores(Sentences([words for _, words in apart]))[beside], truth[beside])


def save(model: Model, spark: SparkSession, path: str) -> None:
    """Write a model as a table: a row for each used weight's bucket, and one with what scales them."""
    used = np.flatnonzero(model.weights.any(axis=1))
    rows = [(int(b), [float(x) for x in model.weights[b]]) for b in used]
    rows.append((-1, [*map(float, model.scale), *model.sure]))
    spark.createDataFrame(rows, "bucket int, weights array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Model:
    """A model that ``save`` wrote; at most BUCKETS + 1 rows."""
    rows = spark.read.parquet(path).toArrow()
    buckets, values = rows.column("bucket").to_numpy(), rows.column("weights").to_pylist()
    head = values[int(np.flatnonzero(buckets == -1)[0])]
    weights = np.zeros((BUCKETS, len(head) - 2), np.float32)
    for bucket, row in zip(buckets, values, strict=True):
        if bucket >= 0:
            weights[bucket] = row
    return Model(weights, np.array(head[:-2], np.float32), (head[-2], head[-1]))


def stored(docs: DataFrame, reference: DataFrame, **bounds: int) -> Model:
    """The model of these tables, fitted by the first caller in a session and read by the others.

    Its name in the shared folder comes from the tables' files; a table that is
    written anew under the same files keeps its model until the session ends.
    """
    spark = docs.sparkSession
    name = sha1(repr((sorted(docs.inputFiles()), sorted(reference.inputFiles()), sorted(bounds.items()))).encode()).hexdigest()
    path = f"{shared_dir(spark).rstrip('/')}/languages-{name}"
    try:
        return load(spark, path)
    except AnalysisException:  # not there yet
        model = train(docs, reference, **bounds)
        save(model, spark, path)
        return model


# --- DataFrames --------------------------------------------------------------


def segments(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, segment, lang, confidence, n_sentences, start_pos, end_pos`` for each stretch in one language."""
    source = docs.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.scale, model.sure))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(Model(*shared.value))
        for batch in slices(batches, "text"):
            at, out = [], []
            for i, stretches in enumerate(judge.texts(batch.column("text").to_pylist())):
                for k, (lang, confidence, a, b, n) in enumerate(stretches):
                    at.append(i)
                    out.append((k + 1, lang, confidence, n, a + 1, b))
            kinds = [pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
            made = [pa.array(x, t) for x, t in zip(list(zip(*out, strict=True)) or [()] * 6, kinds, strict=True)]
            ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *made], names=["doc_id", *NAMES])

    kind = source.schema["doc_id"].dataType.simpleString()
    return spread(source).mapInArrow(
        scan,
        f"doc_id {kind}, segment int, lang string, confidence double, n_sentences int, start_pos long, end_pos long",
    )


NAMES = ("segment", "lang", "confidence", "n_sentences", "start_pos", "end_pos")


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, label, langs``: for each document its label's language, and its languages with confidence and sentences.

    ``langs`` is an array of structs (``lang``, ``confidence``,
    ``n_sentences``), most sentences first, empty for documents without any.
    """
    source = docs.select("doc_id", label_of(F.col("lang")).alias("label"), "text")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.scale, model.sure))
    item = pa.struct([("lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(Model(*shared.value))
        for batch in slices(batches, "text"):
            lists = []
            for stretches in judge.texts(batch.column("text").to_pylist()):
                by: dict[str, list[float]] = {}
                for lang, confidence, _, _, n in stretches:
                    has = by.setdefault(lang, [0.0, 0])
                    has[0] += confidence * n
                    has[1] += n
                lists.append(
                    [
                        {"lang": lang, "confidence": s / n, "n_sentences": int(n)}
                        for lang, (s, n) in sorted(by.items(), key=lambda x: (-x[1][1], x[0]))
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(lists, pa.list_(item))],
                names=["doc_id", "label", "langs"],
            )

    kind = source.schema["doc_id"].dataType.simpleString()
    return spread(source).mapInArrow(
        scan,
        f"doc_id {kind}, label string, langs array<struct<lang: string, confidence: double, n_sentences: int>>",
    )


def mislabelled(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang``: the languages of documents whose label is missing or wrong, and of those in several languages."""
    several = F.size("langs") > 1
    wrong = (F.size("langs") == 1) & ~F.coalesce(F.col("label") == F.col("langs")[0]["lang"], F.lit(False))
    return (
        languages(docs, model)
        .where(several | wrong)
        .select("doc_id", F.explode("langs").alias("l"))
        .select("doc_id", F.col("l.lang").alias("lang"))
    )
