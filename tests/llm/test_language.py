import random

import pytest
from pyspark.sql import functions as F

from cuewright.llm import language
from cuewright.llm.language import LANGUAGES, fit_model, spoken_words

CUE = "source_id string, seg_idx int, start_ms bigint, end_ms bigint, text string, speaker string, top int"
PHRASES = {
    "en": ["the old looms weave the cloth", "we asked whether the harbors are quiet", "nobody told us that this works", "in most villages they rest", "these are the lanterns of the night"],
    "de": ["die alten Webstühle weben das Tuch", "wir haben gefragt ob die Häfen still sind", "niemand hat uns das gesagt", "in vielen Dörfern ruhen sie sich aus", "das sind die Laternen der Nacht"],
    "fr": ["les vieux métiers tissent la toile", "nous avons demandé si les ports sont calmes", "personne ne nous a dit cela", "dans la plupart des villages ils se reposent", "ce sont les lanternes de la nuit"],
    "es": ["los viejos telares tejen la tela", "preguntamos si los puertos están tranquilos", "nadie nos dijo que esto funciona", "en muchos pueblos ellos descansan", "estas son las linternas de la noche"],
    "ko": ["오래된 베틀이 천을 짭니다", "우리는 항구가 조용한지 물었습니다", "아무도 그것을 말하지 않았습니다", "많은 마을에서 그들은 쉽니다", "이것은 밤의 등불입니다"],
    "ja": ["古い織機が布を織ります", "私たちは港が静かかどうか尋ねました", "誰もそれを教えてくれませんでした", "多くの村では彼らは休みます", "これは夜の灯りです"],
}


@pytest.mark.parametrize("label, want", [("en", "en"), ("EN", "en"), ("en_AU", "en"), ("en-orig", "en"), ("English", "en"), ("English (US)", "en"), ("ger", "de"), ("Deutsch", "de"), ("es-419", "es"), ("日本語", "ja"), (" ko-KR ", "ko"), ("und", None), ("", None), ("  ", None), (None, None), ("auto", None), ("zz", None), ("unknown", None)])
def test_labels(spark, label, want):
    assert spark.range(1).select(language.named_language(F.lit(label).cast("string"))).first()[0] == want


def test_spoken_words():
    assert spoken_words("[00:12] <i>Zoskin Skil: Uhm, the looms</i> (music) ♪ la ♪") == ["the", "looms"]
    assert spoken_words("Da ging er um halb los, hmm") == ["da", "ging", "er", "um", "halb", "los"]
    assert spoken_words(None) == [] and spoken_words("♪♪♪") == []


def test_very_long_words():
    assert len(spoken_words("x" * 300_000)) == 9375 and language.grams("abc")[:3] == ["a", "b", "c"]


def corpus(seed, n):
    rnd = random.Random(seed)
    out = []
    for k, lang in enumerate(LANGUAGES):
        for g in range(6):
            label = k if g else (k + 1) % len(LANGUAGES)  # one recording in six is labelled wrong
            out += [(rnd.sample(PHRASES[lang], 2), label, f"{lang}{g}", k) for _ in range(n)]
    return out


def test_model_survives_wrong_labels_and_is_calibrated():
    rows = corpus(1, 30)
    model = fit_model([spoken_words(" ".join(p)) for p, *_ in rows], [y for _, y, *_ in rows], [g for _, _, g, _ in rows])
    held = corpus(2, 10)
    p = language._softmax(model.scores([spoken_words(" ".join(t)) for t, *_ in held]) / model.temperature)
    truth = [k for *_, k in held]
    assert (p.argmax(axis=1) == truth).mean() > 0.99 and p.max(axis=1).mean() > 0.9


def test_recordings_and_foreign_cues(spark):
    rnd = random.Random(3)
    cues, labels, foreign, wrong = [], [], set(), set()
    for k, lang in enumerate(LANGUAGES):
        for g in range(4):
            source, other = f"{lang}-{g}", LANGUAGES[(k + 2) % 6]
            label = {0: lang.upper(), 1: lang, 2: other if lang == "en" else lang, 3: None if lang == "de" else lang + "-XX"}[g]
            labels.append((source, label))
            if label is None or label.lower()[:2] != lang:
                wrong.add((source, -1, lang))
            for i in range(40):
                own = rnd.random() < 0.92
                if not own:
                    foreign.add((source, i, other))
                cues.append((source, i, i, i + 1, f"Zoskin: um, {' '.join(rnd.sample(PHRASES[lang if own else other], 3))} [laughter]", None, 1))
    cues += cues[:50] + [("en-0", 100, 1, 2, None, None, 1), ("en-0", 101, 1, 2, "", None, 1), ("en-0", 102, 1, 2, "Weltschmerz", None, 1), ("absent", 1, 1, 2, PHRASES["fr"][0], None, 1), (None, 1, 1, 2, PHRASES["fr"][0], None, 1)]
    segments = spark.createDataFrame(cues, CUE)
    transcripts = spark.createDataFrame(labels + [("silent", "en")], "source_id string, language string").withColumn("ingested_at", F.lit(1))
    rows = language.spoken_languages(segments, transcripts).collect()
    assert {(r.source_id, r.seg_idx, r.language) for r in rows if r.seg_idx >= 0} == foreign
    assert {(r.source_id, r.seg_idx, r.language) for r in rows if r.seg_idx < 0 and not r.label_agrees} == wrong
    assert len([r for r in rows if r.seg_idx < 0]) == 24 and all(0 < r.confidence <= 1 for r in rows)


def test_empty(spark):
    segments = spark.createDataFrame([], CUE)
    transcripts = spark.createDataFrame([("a", "en")], "source_id string, language string").withColumn("ingested_at", F.lit(1))
    assert language.spoken_languages(segments, transcripts).count() == 0
    assert language.spoken_languages(segments, transcripts.where("false")).count() == 0


def test_without_labels_no_language_is_guessed(spark):
    segments = spark.createDataFrame([("a", 0, 1, 2, PHRASES["de"][0], None, 1)], CUE)
    transcripts = spark.createDataFrame([("a", "und")], "source_id string, language string").withColumn("ingested_at", F.lit(1))
    assert language.spoken_languages(segments, transcripts).count() == 0 and language.languages_of_cues(segments, transcripts).count() == 0


def test_document_frequencies_count_all_cues(spark):
    cues = spark.createDataFrame([("a", i, 1, 2, t, None, 1) for i, t in enumerate(["la lo", "la", "", None, "♪"])], CUE).repartition(3)
    total, seen = language.document_frequency(cues, ["_l", "la", "lo_", "zz"])
    assert total == 2 and seen == {"_l": 2, "la": 2, "lo_": 1}
