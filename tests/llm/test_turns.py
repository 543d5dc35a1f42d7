import random

import pytest
from pyspark.sql import functions as F

from cuewright.llm import layouts, turns
from cuewright.llm.layouts import CHILDREN, NUMBER, WORD, Slots, TokenTree, heads, seconds
from cuewright.llm.turns import HESITATION, People, clean_words, distance, has_words, parts_of

ROWS = [(1, "Zoskin", "Skilsahast"), (2, "Weithox", "Jeitand"), (3, "Moajoal", "Loghund")]
CUE = "source_id string, seg_idx int, start_ms bigint, end_ms bigint, text string, speaker string"
SPEAKER = "speaker_id int, given_name string, family_name string"


@pytest.mark.parametrize(
    "label, who",
    [
        ("Zoskin Skilsahast", 1), ("ZOSKIN", 1), ("zoskin_skilsahast", 1), (" Skilsahast, Zoskin ", 1), ("Z. Skilsahast", 1), ("Zoskin S.", 1), ("Dr. Jeitand", 2), ("Weithox Jeitand (host)", 2), ("Speaker 3", 3), ("SPEAKER_2", 2),
        ("Zsokin Skilsahast", 1), ("Weithhox", 2), ("Jeitad", 2), ("Speaker 9", None), ("Zoskin Jeitand", None), ("Question", None), ("unknown", None), ("???", None), ("", None), ("Zoskin Skilsahast and many others here", None), ("K.", None),
    ],
)
def test_people(label, who):
    assert People(ROWS).find(label) == who


def test_distance_counts_swaps():
    assert distance("jeitand", "jeitnad", 2) == 1 and distance("abc", "abd", 2) == 1 and distance("abcdef", "uvwxyz", 2) == 3 and distance("a", "abcd", 2) == 3


@pytest.mark.parametrize("text, some", [("Uhm...", False), ("[music]", False), ("♪ la la ♪", False), ("*laughs* Er, - um -", False), ("", False), ("음... 어", False), ("えーと", False), ("Um yes", True), ("(door) 12", True), ("第三章", True)])
def test_words(text, some):
    assert has_words(text) is some


@pytest.mark.parametrize("sound", ["uh", "Uhm", "erm", "hmm", "äh", "öhm", "euuh", "heu", "ehm", "음", "으음", "えっと", "あのー", "うーん"])
def test_hesitation(sound):
    assert HESITATION.fullmatch(sound)


# how cues may name a person; the last six are written nowhere in the code
LAYOUTS = ["{0}: {1}", ">> {0}: {1}", "- {0}: {1}", "[{0}] {1}", "({0}) {1}", "<v {0}>{1}", "{2} {0}: {1}", "[{2}] {0}: {1}", "<{2}><i>{0}: {1}</i>", "{2} --> {0}: {1}", "One. {0}: {1}", "One.\n- {0}: {1}", "[music] {0}: {1}", "no marks {0}: {1}", "{0}:\n{1}",
           "{{{{{0}}}}} {1}", "{0} | {1}", "{0} - {1}", "@{0}# {1}", "{2} ~{0}~ {1}", "== {0} == {1}"]
NAMES = {1: ["Zoskin Skilsahast", "Skilsahast", "Z. Skilsahast", "SPEAKER 1"], 2: ["Weithox Jeitand", "JEITAND", "Dr. Jeitand"], 3: ["Loghund", "Moajoal Loghund", "Loghund, Moajoal"]}


def clock(ms):
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def training(seed=5, each=40):
    """Cues in every layout, and plain ones, with the person of each."""
    rnd = random.Random(seed)
    words = [a + b for a in ("wind", "loom", "harbor", "kiln", "sail", "brick", "drum", "reed") for b in ("s", "ing", "ed", "like", "ward")]
    out = []
    for k, layout in enumerate(LAYOUTS):
        for i in range(each):
            who, at = rnd.choice([1, 2, 3]), rnd.randrange(10**7)
            name = rnd.choice(NAMES[who] if "no marks" not in layout else NAMES[who][:1] if who != 3 else NAMES[3][1:2])
            out.append((f"s{k}", i, at, layout.format(name, " ".join(rnd.choices(words, k=5)) + ".", clock(at)), who))
        for i in range(each):
            out.append((f"s{k}", each + i, rnd.randrange(10**7), " ".join(rnd.choices(words, k=6)) + rnd.choice([".", ", then - so: yes.", " (laughs)", " | or"]), None))
    return out


@pytest.fixture(scope="module")
def mined(spark):
    cues = spark.createDataFrame([(s, i, t, t + 1, x, None) for s, i, t, x, _ in training()], CUE)
    return turns.layouts(cues, spark.createDataFrame(ROWS, SPEAKER)).collect()


@pytest.fixture(scope="module")
def slots(mined):
    return Slots([(r.path, r.is_speaker, r.is_time, [c.word for c in r.constants]) for r in mined if r.is_speaker or r.is_time])


def test_slots_are_told_from_values(mined):
    by = {" ".join(r.path): r for r in mined}
    assert by["line <*> |"].is_speaker and by["line { { <*> <*> }"].is_speaker and by["line = = <*> <*> ="].is_speaker and by["line - <*> <*> :"].is_speaker
    assert by["line [ #:#:#.#"].is_time and by["line #:#:#.#"].is_time and by["line [ #:#:#.#"].follows > 0.99 and not by["line [ #:#:#.#"].is_speaker
    assert not any(r.is_speaker for r in mined if not r.people)


def test_every_layout_gives_its_people(slots):
    people = People(ROWS).find
    for source, _, _, text, who in training(seed=6, each=15):
        got = [p[0] for p in parts_of(text, None, people, slots) if p[1] and p[0] is not None]
        assert got == ([who] if who else []), text


def test_more_layouts_than_workers_are_given(spark, monkeypatch):
    """Beyond the bound each cue is cut by the layouts of its own heads, as if all were given; by its value alone, Zoskin would speak in the last cue."""
    cues = [(s, i, t, t + 1, x, None) for s, i, t, x, _ in training(each=12)] + [("c", i, i, i + 1, "more words", label) for i, label in enumerate(["Zoskin", "Speaker 2 (host)", "?", " "] * 4)]
    cues += [("u", i, i, i + 1, f"wind{chr(97 + i % 26)}{chr(97 + i // 26)} # of words", None) for i in range(40)] + [("u", 99, 99, 100, "Zoskin # of words", None), ("u", 100, 101, 102, None, None)]
    cues, people = spark.createDataFrame(cues, CUE), spark.createDataFrame(ROWS, SPEAKER)
    parts = lambda: sorted((r.source_id, r.seg_idx, str(r.parts)) for r in turns.cue_parts(cues, people, with_text=True).collect())
    want = parts()
    monkeypatch.setattr(turns, "MOST_LAYOUTS", 3)
    assert parts() == want
    assert [p for s, i, p in want if (s, i) == ("u", 99)] == ["[Row(person=None, words=True, text='Zoskin # of words')]"]


def test_a_full_tree_drops_no_layout(monkeypatch):
    monkeypatch.setattr(layouts, "NODES", 20)
    tree = TokenTree()
    signs = "|=#@%&~^"
    texts = [f"Zoskin {a}{b} word" for a in signs for b in signs]
    for text in texts:
        for how, tokens in heads(text):
            tree.insert(how, tokens, text, 0.0, lambda v: True)
    made = {" ".join(path): sums[0] for path, sums in tree.merged()[0]}
    assert made == {f"line {WORD} {a}": float(len(signs)) for a in signs} and tree.full
    assert {tuple(x) for text in texts for how, tokens in heads(text) for x in layouts.paths(how, tokens)} >= {tuple(p.split()) for p in made}


def test_without_layouts_nothing_is_named(slots):
    people = People(ROWS).find
    assert [p[0] for p in parts_of("Zoskin: hello", None, people, Slots([]))] == [None]
    assert [p[0] for p in parts_of("Zoskin: hello", None, people, Slots([], complete=False))] == [None, 1]  # too many layouts: by the value alone


def test_times_in_time_slots_are_no_words(slots):
    people = People(ROWS).find
    assert [p[1] for p in parts_of("00:01:02.003", None, people, slots)] == [False] and [p[1] for p in parts_of("00:01:02.003", None, people, Slots([]))] == [True]
    assert parts_of("00:01:02.003 plain words", None, people, slots)[0][2].strip() == "plain words"
    assert seconds("01:02,5") == 62.5 and seconds("1:2:3") == 3723 and seconds("1:99") is None and seconds("3.5") is None


def test_an_unknown_label_stays_in_the_text_but_is_no_word(slots):
    people = People(ROWS).find
    assert parts_of("Question: what now", None, people, slots) == [(None, True, "Question: what now")]
    assert parts_of("Question: [music]", None, people, slots)[0][1] is False
    assert [p[0] for p in parts_of("the end, as Zoskin put it.", None, people, slots)] == [None]


@pytest.mark.parametrize("text", ["\n" * 100_000 + "a: b", "(" * 100_000, "[a" * 50_000, "Zoskin " * 30_000 + ":", ". " * 50_000, "<" * 100_000, ": " * 50_000, "x" * 300_000 + ":", " " * 200_000 + "Zoskin: hi", "*a" * 50_001, "Aa Bb " * 30_000, "1:" * 90_000])
def test_very_long_texts_take_no_time(slots, text):
    import time

    start = time.perf_counter()
    parts_of(text, None, People(ROWS).find, slots)
    assert time.perf_counter() - start < 5


def test_branches_that_differ_in_words_only_are_one_layout():
    tree = TokenTree()
    for k in range(5 * CHILDREN):
        text = f"<v loud name{k}x> word" if k % 2 else f"word{chr(97 + k % 26)}{chr(97 + k // 26)} {k}: more"
        for how, tokens in heads(text):
            tree.insert(how, tokens, text, 0.0, lambda v: v.startswith("name"))
    rows, words = tree.merged()
    made = {" ".join(p): s[0] for p, s in rows}
    assert made[f"line < {WORD} {WORD} {WORD} >"] == 2.5 * CHILDREN and made[f"line {WORD} {NUMBER} :"] == 2.5 * CHILDREN
    assert {w for p, w, n, total in words if w and n == total} >= {"v", "loud"}


def test_words_that_sound_like_hesitation_stay_in_their_language(spark):
    rows = [("Da ging er los, um Brot zu holen.", "de", "Da ging er los, um Brot zu holen."), ("Äh, da ging er um halb los... hmm", "de", "da ging er um halb los..."), ("So um, the er looms", "en", "So the looms"), ("Um the looms", None, "the looms"), ("hum, mhm the looms", "en", "the looms")]
    got = spark.createDataFrame(rows, "t string, l string, want string").withColumn("got", clean_words(F.col("t"), F.col("l"))).collect()
    assert [r.got for r in got] == [r.want for r in got]


def brute(cues, known):
    """Turns by walking the cues, from parts written down when they were made."""
    out = []
    for source in known:
        last, seen = None, set()
        for start, idx, parts in sorted((s, i, p) for src, i, s, p in cues if src == source):
            if idx in seen:
                continue
            seen.add(idx)
            for who, words in parts:
                if words and who is not None and who != last:
                    out.append((source, idx, who))
                    last = who
    return sorted(out)


def test_turns_against_a_walk(spark):
    rnd = random.Random(11)
    names = {1: ["Zoskin", "ZOSKIN SKILSAHAST", "Speaker 1"], 2: ["Weithox Jeitand", "JEITAND"], 3: ["Loghund"]}
    rows, truth = [], []
    for source in ("a", "b", "hot"):
        for i in range(40 if source != "hot" else 200):
            at = rnd.randrange(0, 10**8)
            one, two = rnd.choice([None, 1, 2, 3]), rnd.choice([None, None, None, 1, 2, 3])
            first, second = rnd.choice(["words here.", "[music]", "Uhm..."]), rnd.choice(["more words", "♪♪♪"])
            text = (f"{rnd.choice(names[one])}: " if one else "") + first + (f"\n- {rnd.choice(names[two])}: {second}" if two else "")
            parts = [(one, first == "words here.")] + ([(two, second == "more words")] if two else [])
            rows.append((source, i, at, None, text, None))
            truth.append((source, i, at, parts))
            if rnd.random() < 0.2:
                rows.append((source, i, at, None, "  " + text.replace("words here", "<i>words here</i>"), None))
    rows += [(None, 1, 1, 2, "Zoskin: x", None), ("unknown", 1, 1, 2, "Zoskin: x", None), ("a", None, 1, 2, "Zoskin: x", None), ("b", 999, 5 * 10**8, None, None, None), ("b", 1000, 5 * 10**8 + 1, None, "w " * 50_000, "n/a")]
    known = spark.createDataFrame([("a",), ("b",), ("hot",), ("a",), ("silent",), (None,)], "source_id string")
    cues, people = spark.createDataFrame(rows, CUE), spark.createDataFrame(ROWS, SPEAKER)
    got = sorted((r.source_id, r.first_seg_idx, r.speaker_id) for r in turns.speaker_turns(cues, people, known).collect())
    assert got == brute(truth, ["a", "b", "hot"])
    texts = turns.turn_texts(cues, people, known).collect()
    assert sorted((r.source_id, r.turn_seg_idx, r.speaker_id) for r in texts if r.part == 0) == got
    assert not any("Uhm" in r.text or "♪" in r.text or "music" in r.text for r in texts)


def test_empty_and_extra_columns(spark):
    cues = spark.createDataFrame([], CUE + ", parts string, person int, _cell bigint")
    people = spark.createDataFrame(ROWS, SPEAKER)
    known = spark.createDataFrame([("a",)], "source_id string")
    assert turns.speaker_turns(cues, people, known).count() == 0
    one = spark.createDataFrame([("a", 0, 5, 6, "Zoskin: hi", None, "x", 1)], CUE + ", layout string, part int")
    assert turns.speaker_turns(one, people, known).count() == 1
    assert turns.turn_texts(one, people, known).first().text == "hi"
    assert turns.speaker_turns(one, people.where("false"), known).count() == 0
