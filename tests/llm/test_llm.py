"""Operators of the subpackage llm against brute force, round trips and made-up cases."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vitalake.llm import bpe, mojibake, packing, responses, splits

ASK = "Reply on three lines: Prediction (Yes or No), Probability and Reasoning.\n\n- Diagnoses noted: gout; asthma\n- Drugs given: aspirin"
WORD = "Will the next visit carry a code? Answer with one word, Yes or No.\n\n- Diagnoses noted: gout; asthma"
FULL = "Prediction: No\nProbability: 0.2\nReasoning: Nothing in the record points to it."


@pytest.mark.parametrize(
    ("prompt", "text", "want"),
    [
        (ASK, FULL, []),
        (ASK, FULL + "\nDiagnoses noted: gout; asthma.", []),
        (ASK, FULL + " Please consult a clinician, I cannot diagnose.", []),
        (ASK, None, ["empty"]),
        (ASK, "", ["empty"]),
        (ASK, " \t\n​", ["empty"]),
        (ASK, "Prediction:\nProbability:\nReasoning:", ["empty"]),
        (ASK, "```\n```", ["empty"]),
        (ASK, "I'm sorry, but I can't give a prediction.", ["refusal"]),
        (ASK, "Prediction: As a language model, I must decline.", ["refusal"]),
        (ASK, "Lo siento, pero no puedo responder.", ["refusal"]),
        (ASK, "Prediction: No prediction can be offered here.", ["refusal"]),
        (ASK, ASK, ["copy"]),
        (ASK, ASK.upper(), ["copy"]),
        (ASK, "- Diagnoses noted: gout; asthma\n- Drugs given: aspirin", ["copy"]),
        (ASK, "Prediction: No\nProbability: 0.2\nReasoning: Nothing in the rec", ["truncated"]),
        (ASK, "Prediction: No\nProbability: 0.", ["truncated"]),
        (ASK, "Vorhersage: Nein\nWahrscheinlichkeit: 0.2\nBegründung: Es gibt keinen klaren Hinweis.", ["other_language"]),
        (ASK, "Prediction: No\nProbability: 0.2\nReasoning: Es gibt keinen klaren Hinweis auf eine Störung.", ["other_language"]),
        (WORD, "No.", []),
        (WORD, "**Yes**", []),
        (WORD, "Nein", ["other_language"]),
        (WORD, "否", ["other_language"]),
        (None, "No.", []),
        ("", "x" * 100_000 + ".", []),
    ],
)
def test_defects(prompt, text, want):
    assert responses.defects(prompt, text) == want


@pytest.mark.parametrize(
    ("prompt", "text", "want"),
    [
        ("¿Tendrá la próxima visita un código? Responda con una palabra, Sí o No.", "No puedo responder a esa pregunta.", ["refusal"]),
        ("A próxima visita terá um código? Responda com uma palavra, Sim ou Não.", "Não posso responder a essa pergunta.", ["refusal"]),
        ("下次就诊会有代码吗？请用一个词回答。", "无法回答这个问题。", ["refusal"]),
        (WORD, "No, I cannot help with that.", ["refusal"]),
        (WORD, "No, the record doesn't point to it; I cannot diagnose though.", []),
        (WORD, "No. I can't rule it out.", []),
        (ASK, "Prediction: No\nProbability: 0.2\nReasoning: Die Patientin nimmt Metformin; Blutzuckerwerte stiegen zuletzt an.", ["other_language"]),
        (ASK, "Prediction: No\nProbability: 0.2\nReasoning: Il paziente non presenta segni di alterazione.", ["other_language"]),
        (ASK, "Prediction: No\nProbability: 0.2\nReasoning: De patiënt heeft daar geen aanwijzingen voor.", ["other_language"]),
    ],
)
def test_defects_in_any_language(prompt, text, want):
    assert responses.all_defects(prompt, text) == want


def test_finish_reason_is_a_hint():
    whole = "The labs were fine and the dose is 0."
    assert responses.all_defects("", whole) == []
    assert responses.all_defects("", whole, "max_tokens") == ["truncated"]
    assert responses.all_defects(ASK, FULL, "length") == []
    assert responses.all_defects(ASK, FULL, "content_filter") == []
    assert responses.all_defects(WORD, "Yes. As a language model, I must decline.", "content_filter") == ["refusal"]
    assert responses.all_defects(WORD, "Yes. As a language model, I must decline.", "stop") == []


@pytest.mark.parametrize(
    ("prompt", "text", "want"),
    [
        (ASK, FULL, []),
        (ASK, None, ["empty"]),
        (ASK, "```\n```", ["empty"]),
        (ASK, "Prediction:\nProbability:\nReasoning:", ["empty", "truncated"]),
        (WORD, "I'm sorry, but I can't give a prediction.", ["refusal"]),
        (ASK, "Prediction: As a language model, I must decline.", ["refusal", "truncated"]),
        (WORD, "I'm sorry, but I can't give a predi", ["refusal", "truncated"]),
        (WORD, "Lo siento, pero no puedo responder a esta pregunta.", ["refusal", "other_language"]),
        (ASK, "Lo siento, pero no puedo responder.", ["refusal", "other_language", "truncated"]),
        (WORD, WORD[:-3], ["copy", "truncated"]),
        (WORD + " As a language model you know.", "- Diagnoses noted: gout; asthma. As a language model you know.", ["refusal", "copy"]),
    ],
)
def test_all_defects(prompt, text, want):
    assert responses.all_defects(prompt, text) == want


def test_defects_by_row(spark):
    df = spark.createDataFrame([(1, ASK, "Lo siento, pero no puedo responder.")], "response_id bigint, prompt string, text string")
    assert [tuple(r) for r in responses.flag_responses(df).collect()] == [(1, ["refusal", "other_language", "truncated"], "refusal")]


def test_flag_responses(spark):
    rows = [(1, ASK, FULL, "x"), (2, ASK, None, "x"), (2, ASK, None, "x"), (None, None, "", "x"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "response_id bigint, prompt string, text string, defect string")
    got = sorted((r.response_id or 0, r.defect) for r in responses.flag_responses(df).collect())
    assert got == [(0, "empty"), (2, "empty"), (2, "empty"), (3, "empty")]
    assert responses.flag_responses(df.limit(0)).count() == 0


def wrong(text, *codecs):
    for c in codecs:
        text = text.encode("utf-8").decode(c)
    return text


@pytest.mark.parametrize("text", ["Déjà vu, café, ≥ 5", "Sjögren’s – 3 €", "не найдено", "诊断", "zażółć gęślą jaźń"])
@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850"])
def test_restored(text, codec):
    try:
        bad = wrong(text, codec)
    except UnicodeDecodeError:
        pytest.skip("can't be taken for this")
    got, ways = mojibake.restore(f"Plan: {bad} end")
    assert ways
    assert got == f"Plan: {text} end"


def test_restored_twice():
    bad = wrong("Déjà vu – naïve", "cp1252", "cp1252")
    assert mojibake.restore(bad)[0] == "Déjà vu – naïve"


def test_single_byte():
    assert mojibake.restore("Iniciada medicaÁ„o com a situaÁ„o")[0] == "Iniciada medicação com a situação"
    bad = "Пульс в минуту, давление высокое".encode("cp1251").decode("koi8_r")
    assert mojibake.restore(bad)[0] == "Пульс в минуту, давление высокое"
    assert mojibake.restore("AVALIA��O")[1] == ["lost"]
    assert mojibake.restore("DÈj‡ vu, 7 ◊ 2 cm")[0] == "Déjà vu, 7 × 2 cm"
    assert mojibake.restore("ÒÅ×ÅÍÈÅ:\nПульс в норме")[0] == "ТЕЧЕНИЕ:\nПульс в норме"


@pytest.mark.parametrize(
    "text",
    [None, "", "  ", "plain", "AVALIAÇÃO: NÃO há", "Пульс 80 в минуту, всё хорошо", "ЛЁГКИЕ БЕЗ ХРИПОВ", "诊断: 未见", "x ≥ 5 ± 2 → ✓ ☐ ③ 😀",
     "Déjà vu", "naïve “quoted” l’été", "zażółć gęślą jaźń", "À l'entrée; Ménière", "5 µg/kg, 37 °C, 7 × 9 cm", "«Пульс» – 80", "TNFα, 5 Ω, Straße, el país así", "Où est-il ? L’Étude", "¿Señal? Sí, 5 ó 6"],
)
def test_correct_text_is_left(text):
    assert mojibake.restore(text) == (text, [])


SCRIPTS = [
    "المريض يعاني من ألم في الصدر", "환자는 가슴 통증을 호소했다", "החולה מתלונן על כאבים בחזה", "患者は胸の痛みをうったえた。テスト", "Пацієнт скаржиться на біль у грудях, її стан",
    "Bệnh nhân được chẩn đoán đau ngực", "ผู้ป่วยมีอาการเจ็บหน้าอก", "रोगी को सीने में दर्द है", "Ὁ ἀσθενὴς ἔχει πόνον ἐν τῷ στήθει", "Le patient a présenté une fièvre élevée à l’entrée", "患者诉胸痛，未见异常",
]


@pytest.mark.parametrize("text", SCRIPTS)
def test_restored_in_any_script(text):
    def as_cp1252(t):
        return "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in t.encode())

    assert mojibake.restore(f"Note: {as_cp1252(text)}") == (f"Note: {text}", ["cp1252"])
    assert mojibake.restore(as_cp1252(as_cp1252(text)))[0] == text
    assert mojibake.restore(text) == (text, [])


#: Words whose correct forms look odd in one way or another.
WORDS = (
    "côté école œuvre naïf maïs Noël français señal año corazón ação irmã pôr Straße Größe übel Ärztin Ängste zażółć gęślą współ ogół święto łódź "
    "smörgås Ångström Ørsted kærlighed őrült žlutý kůň McÉwan DeÁngelis CÔTÉs LeÓn Всё ёлка приём моё СССР її ДІАГНОЗ ґрунт Αθήνα TNFα TGFβ1 Aδ xβy λόγος 5µg 37°C"
).split()
WRAPS = ["{}", "«{}»", "“{}”", "„{}“", "({})", "—{}—", "l’{}", "{}…", "‘{}’", "\xa0{}\xa0", "{}™", "1 ± 2 {} ≥ 3"]


def test_no_correct_text_is_changed():
    texts = {wrap.format(case(word)) for word in WORDS for wrap in WRAPS for case in (str, str.upper, str.lower, str.capitalize)}
    texts |= {f"{a} {b}" for a, b in itertools.product(WORDS, WORDS) if a < b}
    wrongly = [t for t in texts if mojibake.restore(t) != (t, [])]
    assert len(texts) > 2500
    assert wrongly == []


def test_restored_to_the_end():
    deep = wrong("Déjà vu", *["latin-1"] * 7)
    assert mojibake.restore(deep)[0] == "Déjà vu"
    several = " / ".join(wrong("Déjà vu – naïve", *c) for c in (["cp1252"] * 4, ["mac_roman"]))
    assert mojibake.restore(several)[0] == " / ".join(["Déjà vu – naïve"] * 2)


def test_restore_texts(spark):
    df = spark.createDataFrame([(1, "cafÃ©", "z"), (1, "cafÃ©", "z"), (None, "cafÃ©", None), (2, None, ""), (3, "", "")], "doc_id bigint, text string, ways string")
    got = mojibake.restore_texts(df).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1]
    assert {r.restored for r in got} == {"café"}
    assert all(r.whole for r in got)


def brute(piece, rank):
    parts = [bytes([b]) for b in piece]
    while True:
        pairs = [(rank.get(a + b, bpe.NEVER), i) for i, (a, b) in enumerate(itertools.pairwise(parts))]
        if not pairs or min(pairs)[0] == bpe.NEVER:
            return [rank[p] for p in parts]
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.fixture(scope="module")
def rank():
    return bpe.vocabulary()


def test_merge_is_brute_force(rank):
    rng = random.Random(0)
    for _ in range(300):
        piece = bytes(rng.choice(b"aeinorst the\xc3\xa9") for _ in range(rng.randint(1, 40)))
        if rank.get(piece) is None:
            assert bpe.merge(piece, rank) == brute(piece, rank)


def test_encode_matches_libraries(rank):
    tiktoken = pytest.importorskip("tiktoken")
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=rank, special_tokens={})
    e = bpe.Encoder(rank)
    for t in ["", " ", "a" * 3000, "ab" * 2000, "I'll go,  don't\n\n x", "Déjà vu 诊断 😀", "<|endoftext|> 12345", "\u0000�", "\r\n\t "]:
        assert e.encode(t) == own.encode_ordinary(t)
    assert e.encode(None) == []


def test_encode_texts(spark, rank):
    df = spark.createDataFrame([(1, "a b", 1), (2, "", 2), (3, None, 3), (None, " ", 4), (1, "a b", 1)], "doc_id bigint, text string, ids int")
    got = sorted((r.doc_id or 0, tuple(r.ids)) for r in bpe.encode_texts(df).collect())
    e = bpe.Encoder(rank)
    assert got == [(0, tuple(e.encode(" "))), (1, tuple(e.encode("a b"))), (1, tuple(e.encode("a b"))), (2, ()), (3, ())]
    assert bpe.encode_texts(df.limit(0)).count() == 0


def test_pack(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([3, 40, 40, 200, 900, 1500, 2048])) for i in range(3000)] + [(9001, 5000), (9002, 0), (9003, None), (9004, 4096)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_tokens int")
    got = packing.pack(df).collect()
    assert Counter(r.doc_id for r in got if r.doc_id < 9000) == Counter(range(3000))
    assert sorted(r.n_tokens for r in got if r.doc_id == 9001) == [904, 2048, 2048]
    assert sorted(r.n_tokens for r in got if r.doc_id == 9004) == [2048, 2048]
    fill = Counter()
    for r in got:
        fill[r.container] += r.n_tokens
    assert max(fill.values()) <= 2048
    bins = []
    for n in sorted((r.n_tokens for r in got if r.n_tokens), reverse=True):  # first fit decreasing
        i = next((i for i, b in enumerate(bins) if b + n <= 2048), None)
        if i is None:
            bins.append(n)
        else:
            bins[i] += n
    assert len(fill) <= 1.01 * len(bins)
    assert set(fill) == set(range(len(fill)))
    windows, of = Counter(), {}
    for r in got:
        if r.n_tokens:
            windows[r.window] += r.n_tokens
            assert of.setdefault(r.window, (r.window_size, r.container)) == (r.window_size, r.container)
            assert r.n_tokens <= r.tier <= r.window_size
            assert r.tier == min(t for t in packing.TIERS if t >= r.n_tokens)
    assert all(windows[w] <= of[w][0] for w in windows)
    assert {r.window_size for r in got if r.n_tokens and r.window_size > r.tier}  # gaps of longer windows were filled
    per_group = Counter()
    for c, n in fill.items():
        per_group[next(r.step_group for r in got if r.container == c)] += n
    assert max(per_group.values()) < 1.01 * min(per_group.values()) + 2048
    assert packing.pack(df.limit(0)).count() == 0


def test_plan_by_tiers():
    rng = random.Random(2)
    counts = Counter(min(2048, int(rng.lognormvariate(5.5, 1.0)) + 1) for _ in range(20_000))
    made = {t: packing.plan(counts, 2048, t) for t in (packing.TIERS, (2048,), (2048, 512), (2048, 300, 77))}
    least = -(-sum(s * n for s, n in counts.items()) // 2048)
    for tiers, p in made.items():
        assert set(p.per_tier()) == set(tiers)
        assert sum(units for _, units in p.per_tier().values()) == sum(s * n for s, n in counts.items())
        assert least <= p.containers <= (least + 5 if tiers in (packing.TIERS, (2048,)) else 1.03 * least)
        assert sum(fill * n for fill, _, n in p.fills) == sum(s * n for s, n in counts.items())
        assert [f for f, _, _ in p.fills] == sorted((f for f, _, _ in p.fills), reverse=True)
    assert len({tuple(sorted(p.items)) for p in made.values()}) == 4
    # An item of the short tier fills the gap of the long window; the rest gets windows of its own length.
    p = packing.plan({1500: 1, 500: 1, 400: 1, 200: 3}, 2048, (2048, 512))
    assert (p.per_tier(), p.containers) == ({2048: (1, 2000), 512: (3, 1000)}, 2)
    many = packing.plan({s: n * 10**9 for s, n in counts.items()}, 2048)
    assert len(many.items) <= 3 * len(made[packing.TIERS].items)


def test_components_brute(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 1), (5, None)], "a bigint, b bigint")
    got = {r.node: r.root for r in splits.components(df).collect()}
    assert got == {x: find(x) for x in list(root)}


def test_pair_groups_and_split(spark):
    rng = random.Random(3)
    pairs = [(i, rng.randint(0, 400) if rng.random() < 0.95 else None, 10_000 + i, 20_000 + i, int(rng.random() < 0.3)) for i in range(900)]
    df = spark.createDataFrame(pairs, "pair_id bigint, subject_id bigint, hadm_id_current bigint, hadm_id_next bigint, label_lipid_disorder int")
    adm = spark.createDataFrame([(10_001, 7_001), (10_002, 7_001), (20_003, 7_001), (None, 1), (5, None)], "hadm_id bigint, subject_id bigint")
    groups = splits.pair_groups(df, adm)
    got = {r.pair_id: r.group_pair_id for r in groups.collect()}
    assert len(got) == 900
    assert got[1] == got[2] == got[3]
    assert all(v <= k for k, v in got.items())
    parts = splits.grouped_split(
        groups.select(F.col("pair_id").alias("id"), F.col("group_pair_id").alias("root")),
        df.select(F.col("pair_id").alias("id"), F.col("label_lipid_disorder").alias("label")),
    ).collect()
    assert len(parts) == 900
    assert all(len({p.split for p in parts if p.root == r}) == 1 for r in {p.root for p in parts})
    sizes = Counter(p.split for p in parts)
    assert abs(sizes["train"] - 720) < 15
    assert abs(sizes["test"] - 90) < 12
    label = {p[0]: p[4] for p in pairs}
    share = {s: sum(label[p.id] for p in parts if p.split == s) / sizes[s] for s in sizes}
    assert max(share.values()) - min(share.values()) < 0.08


def test_allot_many():
    given = splits.allot([((1, 0), 10**9), ((0, 1), 10**6), ((5, 5), 3)])
    assert [sum(r) for r in given] == [10**9, 10**6, 3]
    assert abs(given[0][0] - 8 * 10**8) < 10**4


def test_split_of_many_labels(spark, monkeypatch):
    rng = random.Random(3)
    sizes = [rng.choice([1, 1, 1, 2, 3, 5]) for _ in range(1500)] + [400]
    rows, at = [], 0
    for n in sizes:
        rows += [(at + i, at, rng.choice([None, *range(80)])) for i in range(n)]
        at += n
    df = spark.createDataFrame(rows, "id bigint, root bigint, label bigint")
    monkeypatch.setattr(splits, "MOST_PROFILES", 100)  # rarest labels and octaves
    monkeypatch.setattr(splits, "LARGEST", 3)
    got = splits.grouped_split(df.select("id", "root"), df.select("id", "label")).collect()
    assert sorted(r.id for r in got) == list(range(at))
    of = {}
    for r in got:
        assert of.setdefault(r.root, r.split) == r.split
    n = Counter(r.split for r in got)
    assert all(abs(n[s] / at - p) < 0.03 for s, p in zip(splits.SPLITS, splits.PROPORTIONS, strict=True))
    assert splits.grouped_split(df.limit(0).select("id", "root"), df.limit(0).select("id", "label")).count() == 0
