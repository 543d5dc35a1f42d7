"""The language of recordings and of single cues, by a calibrated linear model over character n-grams."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cuewright.llm.turns import _SOUND, PLAIN_HESITATION
from cuewright.operators.ordered import join_one
from cuewright.sources.tables import counted_cues, valid_transcripts
from cuewright.staging import stage

# Spellings of the languages in labels, folded to lower case.
SPELLINGS = {
    "en": ["en", "eng", "english", "anglais", "englisch", "inglés", "ingles", "영어", "英語"],
    "de": ["de", "deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman", "독일어", "ドイツ語"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais", "französisch", "francés", "frances", "프랑스어", "フランス語"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano", "castilian", "espagnol", "spanisch", "스페인어", "スペイン語"],
    "ko": ["ko", "kor", "korean", "한국어", "조선말", "coréen", "coreano", "koreanisch", "韓国語"],
    "ja": ["ja", "jpn", "jp", "japanese", "日本語", "japonais", "japonés", "japones", "japanisch", "일본어"],
}
LANGUAGES = list(SPELLINGS)

#: Lengths of the n-grams, and texts of the sample that must hold one for it to be a feature.
LENGTHS, LEAST_TEXTS = (1, 2, 3, 4), 3
#: The labelled sample that the model is fitted on: recordings and cues of each language at most.
SAMPLE_SOURCES, SAMPLE_CUES = 60, 1_200
#: Confidence from which a cue counts as spoken in another language than the recording, and words it needs.
SURE, LEAST_WORDS = 0.99, 3
#: The same for cues in the signs of one language, which a model of the script can't confuse: confidence and signs.
SURE_SIGNS, LEAST_SIGNS = 0.6, 4

# what is no speech: times, tags, voices, and whatever looks like the name of a speaker
_TIME = r"\d{1,6}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_TIMES = re.compile(rf"[<\[(]\s*{_TIME}\s*[>\])]|^\s*{_TIME}(?:\s*-->(?:\s*{_TIME})?)?(?=\s|$)")
_TAGS = re.compile(r"</?[a-zA-Z](?:[.\w-]*)?(?:\s[^<>]*)?>")
_NAME = r"[^\W\d_][\w'’.\-]{0,40}"
_LABEL = re.compile(
    rf"(?:(?:^|\n|(?<=[.!?。！？…♪*)\]\"”»:：]))\s*(?:>>|[-–—])?|>>|\n\s*[-–—])\s*(?:(?:(?i:speaker)[ _]*\d{{1,9}})|{_NAME}(?:[\s,]+{_NAME}){{0,2}})\s?[:：](?=\s|$)"
    rf"|(?<=\s)(?:[^\W\d_a-z]{_NAME}\s+[^\W\d_a-z]{_NAME})\s?[:：](?=\s|$)"
)
_WORD = re.compile(r"[一-鿿々]+[ぁ-ゖ]*|[ァ-ヺー]+|[ぁ-ゖ]+|[가-힣]+|[^\W\d_]+")
_SIGN = re.compile(r"[ぁ-ヺ一-鿿々가-힣]")
#: Signs after which a word goes on as another, in any text, so that no word's n-grams grow with it.
LONGEST = 32


def named_language(label: Column) -> Column:
    """The language a label names in any common spelling, or null: a code or name, with a region or other suffix or without."""
    folded = F.lower(F.trim(label))
    base = F.regexp_extract(folded, r"^([^\s_\-()/,;.]+)", 1)
    known = F.create_map(*[F.lit(x) for lang, names in SPELLINGS.items() for n in names for x in (n, lang)])
    return F.coalesce(F.try_element_at(known, folded), F.try_element_at(known, base))


#: Whether words count as speech, kept up to a bound.
_COUNTS: dict[str, bool] = {}


def spoken_words(text: str | None) -> list[str]:
    """The words of a cue without times, markup, sounds, hesitation and the names of speakers, folded to lower case."""
    if not text:
        return []
    text = text.replace("\xa0", " ")
    if "<" in text or ":" in text or "[" in text or "(" in text or "*" in text or "♪" in text or "：" in text:
        text = _TIMES.sub(" ", text)
        if "<" in text:
            text = _TAGS.sub(" ", text)
        text = _SOUND.sub(" ", text)
        if ":" in text or "：" in text:
            text = _LABEL.sub(" ", text)
    words = []
    for w in _WORD.findall(text.lower()):
        counts = _COUNTS.get(w)
        if counts is None:
            if len(_COUNTS) > 200_000:
                _COUNTS.clear()
            counts = PLAIN_HESITATION.fullmatch(w) is None
            if len(w) <= LONGEST:
                _COUNTS[w] = counts
        if counts:
            if len(w) <= LONGEST:
                words.append(w)
            else:
                words += [w[i : i + LONGEST] for i in range(0, len(w), LONGEST)]
    return words


def grams(word: str) -> list[str]:
    """The character n-grams of a word with its edges."""
    w = f"_{word}_"
    return [w[i : i + n] for n in LENGTHS for i in range(len(w) - n + 1) if n > 1 or 0 < i < len(w) - 1]


#: The mean of a text's terms is multiplied by this, so that weights stay in the range the penalties are made for.
SCALE = 10.0


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


#: A number of texts, and how many of them hold each n-gram.
Frequency = tuple[int, dict[str, int]]


def _seen(texts: list[list[str]]) -> Counter:
    return Counter(g for words in texts for g in {g for w in words for g in grams(w)})


def features_of(texts: list[list[str]]) -> list[str]:
    """The n-grams that enough of the texts hold."""
    return sorted(g for g, n in _seen(texts).items() if n >= LEAST_TEXTS)


class Model:
    """Multinomial logistic regression, fitted by follow-the-regularised-leader with elastic-net penalties."""

    def __init__(self, classes: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05) -> None:
        self.classes, self.alpha, self.beta, self.l1, self.l2 = classes, alpha, beta, l1, l2
        self.vocabulary: dict[str, int] = {}
        self.idf, self.temperature = np.zeros(0), 1.0
        self.z = self.n = np.zeros((1, classes))  # the last row is the bias

    def weights(self, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[rows]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(self.n[rows])) / self.alpha + self.l2)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and TF-IDF of a text: each n-gram's share of all n-grams, weighed by its document frequency. Unknown ones count in the total only."""
        all_ = [g for w in words for g in grams(w)]
        index, count = np.unique(np.array([k for g in all_ if (k := self.vocabulary.get(g)) is not None], np.int64), return_counts=True)
        return np.append(index, len(self.vocabulary)), np.append(SCALE * count / max(1, len(all_)) * self.idf[index], 1.0)

    def fit(self, texts: list[list[str]], labels: list[int], epochs: int = 3, seed: int = 7, frequency: Frequency | None = None) -> Model:
        """``frequency`` has the number of texts and those that hold each n-gram, of all there are; else the given ones count."""
        kept = features_of(texts)
        self.vocabulary = {g: k for k, g in enumerate(kept)}
        total, seen = frequency or (len(texts), _seen(texts))
        self.idf = np.array([math.log((1 + total) / (1 + seen.get(g, 0))) + 1 for g in kept])
        self.z, self.n = np.zeros((len(kept) + 1, self.classes)), np.zeros((len(kept) + 1, self.classes))
        rows = [self.features(w) for w in texts]
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                i, x = rows[k]
                w = self.weights(i)
                p = _softmax(x @ w)
                p[labels[k]] -= 1
                g = x[:, None] * p
                n = self.n[i]
                self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
                self.n[i] = n + g * g
        return self

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        w = self.weights()
        return np.array([x @ w[i] for i, x in map(self.features, texts)])

    def calibrate(self, scores: np.ndarray, labels: np.ndarray) -> Model:
        """Choose the temperature that makes held-out labels likeliest. Labels may be wrong, so each text counts a little for every class."""

        def loss(t: float) -> float:
            p = _softmax(scores / t)
            return -np.log(0.98 * p[np.arange(len(labels)), labels] + 0.02 / p.shape[1]).mean()

        self.temperature = float(min(np.geomspace(0.2, 5, 60), key=loss))
        return self

    def compact(self) -> tuple[dict[str, int], np.ndarray, np.ndarray, float]:
        """What scoring needs: n-grams with a weight, their weights times the document frequency's, the bias, the temperature."""
        w = self.weights()
        used = [(g, k) for g, k in self.vocabulary.items() if w[k].any()]
        rows = [k for _, k in used]
        return {g: i for i, (g, _) in enumerate(used)}, (w[rows] * self.idf[rows, None] * SCALE).astype(np.float32), w[-1], self.temperature


def fit_model(texts: list[list[str]], labels: list[int], groups: list[str], frequency: Frequency | None = None) -> Model:
    """Fit on labelled texts, some of which are wrong.

    Two models, each fitted on half of the groups (recordings), vote on the other half, so that none judges what it has
    learned by heart. Groups whose vote contradicts their label, and texts that do, are left out of the final model. A
    fifth of the rest is held out to calibrate it.
    """
    y, group = np.array(labels), np.unique(groups, return_inverse=True)[1]
    p = np.zeros((len(y), len(LANGUAGES)))
    for part in (0, 1):
        other, mine = np.nonzero(group % 2 != part)[0], np.nonzero(group % 2 == part)[0]
        if len(other) and len(mine):
            half = Model(len(LANGUAGES)).fit([texts[i] for i in other], y[other].tolist(), epochs=2, frequency=frequency)
            p[mine] = _softmax(half.scores([texts[i] for i in mine]))
        else:
            p[mine, y[mine]] = 1
    votes = np.zeros((group.max() + 1, p.shape[1]))
    np.add.at(votes, group, p)
    keep = np.nonzero((votes.argmax(axis=1)[group] == y) & (p.argmax(axis=1) == y))[0]
    held = keep[np.arange(len(keep)) % 5 == 0] if len(keep) > 50 else keep
    used = np.setdiff1d(keep, held) if len(keep) > 50 else keep
    model = Model(len(LANGUAGES)).fit([texts[i] for i in used], [labels[i] for i in used], frequency=frequency)
    return model.calibrate(model.scores([texts[i] for i in held]), y[held])


def sample(segments: DataFrame, labelled: DataFrame) -> list[tuple[str, str, str]]:
    """At most SAMPLE_CUES cues (language, text, source) of each language, of SAMPLE_SOURCES recordings, chosen by hash."""
    by = lambda *c: Window.partitionBy("named").orderBy(F.xxhash64(*c), *c)
    some = labelled.where("named IS NOT NULL").withColumn("_k", F.row_number().over(by("source_id"))).where(F.col("_k") <= SAMPLE_SOURCES).select("source_id", "named")
    cues = segments.where(F.length("text") > 7).select("source_id", "seg_idx", "text").join(F.broadcast(some), "source_id")  # some: SAMPLE_SOURCES a language
    cues = cues.withColumn("_k", F.row_number().over(by("source_id", "seg_idx", "text"))).where(F.col("_k") <= SAMPLE_CUES)
    return [(r.named, r.text, r.source_id) for r in cues.select("named", "text", "source_id", "seg_idx").orderBy("named", "source_id", "seg_idx", "text").collect()]


def document_frequency(cues: DataFrame, features: list[str]) -> Frequency:
    """In how many of all cues with words each n-gram is, and the number of these cues. Each task adds up its own first."""
    known = cues.sparkSession.sparkContext.broadcast({g: k for k, g in enumerate(features)})  # n-grams of the sample

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = known.value
        counts = np.zeros(len(place), np.int64)
        held, n = np.zeros((128, len(place)), bool), 0  # of some cues at a time which n-grams they hold
        of_word: dict[str, np.ndarray] = {}
        texts = 0
        for b in batches:
            if len(of_word) > 200_000:
                of_word.clear()
            for text in b["text"].tolist():
                words = spoken_words(text)
                if not words:
                    continue
                row = held[n]
                for w in words:
                    at = of_word.get(w)
                    if at is None:
                        at = of_word[w] = np.array([k for g in grams(w) if (k := place.get(g)) is not None], np.int64)
                    row[at] = True
                texts += 1
                n += 1
                if n == len(held):
                    counts += np.count_nonzero(held, axis=0)
                    held[:], n = False, 0
        counts += np.count_nonzero(held[:n], axis=0)
        some = np.nonzero(counts)[0]
        yield pd.DataFrame({"gram": np.append(some, -1), "n": np.append(counts[some], texts)})

    rows = cues.where("text IS NOT NULL").select("text").mapInPandas(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()  # a row an n-gram
    found = {r.gram: r.n for r in rows}
    return found.pop(-1, 0), {features[k]: n for k, n in found.items()}


def _classify(model: tuple[dict[str, int], np.ndarray, np.ndarray, float], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    vocabulary, weights, bias, temperature = model
    rows: dict[str, int] = {}
    table = np.zeros((1024, len(bias) + 1), np.float32)  # per word: sum of its terms' weights, number of terms
    for b in batches:
        if len(rows) > 400_000:
            rows.clear()
        each, counts, signs = [], [], []
        for text in b["text"].tolist():
            w = spoken_words(text)
            for x in w:
                k = rows.get(x)
                if k is None:
                    k = rows[x] = len(rows)
                    if k >= len(table):
                        table = np.concatenate([table, np.zeros_like(table)])
                    g = grams(x)
                    table[k, :-1] = weights[[j for y in g if (j := vocabulary.get(y)) is not None]].sum(axis=0)
                    table[k, -1] = len(g)
                each.append(k)
            counts.append(len(w))
            signs.append(sum(map(len, w)) if w and _SIGN.match(w[0]) else 0)
        n = np.array(counts)
        some = np.nonzero(n)[0]
        if len(some):
            starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
            sums = np.add.reduceat(table[np.array(each)].astype(np.float64), starts, axis=0)
            p = _softmax((sums[:, :-1] / sums[:, -1:] + bias) / temperature)
            top = p.argmax(axis=1)
            out = b[["source_id", "seg_idx"]].iloc[some]
            yield out.assign(top=top.astype(np.int32), confidence=p[np.arange(len(top)), top], words=n[some].astype(np.int32), signs=np.array(signs)[some].astype(np.int32))


def cue_languages(segments: DataFrame, transcripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cues with words, each once (``source_id, seg_idx, top, confidence, words, signs``), and the valid labels (``source_id, label, named``).

    Only cues of known sources count. ``top`` is the number of the likeliest language.
    """
    labels = stage(valid_transcripts(transcripts, ["language"]).select("source_id", F.col("language").alias("label"), named_language(F.col("language")).alias("named")), "labels")
    chosen = sample(segments, labels)
    rows = [(w, LANGUAGES.index(lang), source) for lang, text, source in chosen if (w := spoken_words(text))]
    if not rows:  # nothing to learn from: no language is told rather than guessed
        none = segments.where("false").select("source_id", F.col("seg_idx").cast("int"), F.lit(0).alias("top"), F.lit(0.0).alias("confidence"), F.lit(0).alias("words"), F.lit(0).alias("signs"))
        return none, labels
    cues = segments.where("source_id IS NOT NULL AND seg_idx IS NOT NULL AND text IS NOT NULL").select("source_id", F.col("seg_idx").cast("int"), "text")
    texts, named, groups = map(list, zip(*rows))
    model = fit_model(texts, named, groups, document_frequency(cues, features_of(texts))).compact()
    known = segments.sparkSession.sparkContext.broadcast(model)  # n-grams of the sample
    scored = cues.mapInPandas(lambda b: _classify(known.value, b), "source_id string, seg_idx int, top int, confidence double, words int, signs int")
    return stage(counted_cues(scored, labels, keep=("confidence", "top", "words", "signs")), "languages"), labels


def _code(number: str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), F.col(number) + 1)


def languages_of_cues(segments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """The language of each cue with words: its own where the model is sure, else its recording's: ``source_id, seg_idx, language``."""
    cues, _ = cue_languages(segments, transcripts)
    with_main = join_one(cues, main_languages(cues).select("source_id", "main"), "source_id", "seg_idx", "inner")
    return with_main.select("source_id", "seg_idx", F.when(_is_sure(), _code("top")).otherwise(_code("main")).alias("language"))


def _is_sure() -> Column:
    return ((F.col("confidence") >= SURE) & (F.col("words") >= LEAST_WORDS)) | ((F.col("confidence") >= SURE_SIGNS) & (F.col("signs") >= LEAST_SIGNS))


def main_languages(cues: DataFrame) -> DataFrame:
    """Per source the language that most of its cues, by confidence and up to ten words each, are in: ``source_id, main, confidence``."""
    weight = F.col("confidence") * F.least("words", F.lit(10))
    by = cues.groupBy("source_id", "top").agg(F.sum(weight).alias("w"))
    return by.groupBy("source_id").agg(F.max_by("top", F.struct("w", "top")).alias("main"), (F.max("w") / F.sum("w")).alias("confidence"))


def spoken_languages(segments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Every source's main language (``seg_idx`` -1) and every cue in another language, each with a confidence.

    Returns ``source_id, seg_idx, language, confidence, label_agrees``; the last is null for cues. A cue is in another
    language if the model is sure and the cue has several words. Null and empty texts, and sources without words, get no
    row; a null or unknown label agrees with nothing. Where no source has a usable label there is nothing to learn from and no row. Repeated cues count once; extra columns are ignored.
    """
    cues, labels = cue_languages(segments, transcripts)
    main = stage(main_languages(cues), "main")
    whole = main.join(labels, "source_id").select("source_id", F.lit(-1).alias("seg_idx"), _code("main").alias("language"), "confidence", F.coalesce(F.col("named") == _code("main"), F.lit(False)).alias("label_agrees"))
    other = join_one(cues.where(_is_sure()), main.select("source_id", "main"), "source_id", "seg_idx", "inner").where("top <> main")
    return whole.unionByName(other.select("source_id", "seg_idx", _code("top").alias("language"), "confidence", F.lit(None).cast("boolean").alias("label_agrees")))
