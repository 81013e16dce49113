import hashlib
import json
import random

import pytest
from abuse_held_out import HELD_OUT

from auditloom.llm import abuse, completeness, language, packing, pairs, tokens

JSON = '{"evidence_present":true,"evidence_region":[1,2,3,4],"visible_attributes":["rolled margins"],"diagnosis":{"status":"supported","pest_id":3,"pest_name":"vine moth","species":null,"stage":null},"reliability":"supported"}'
SAID = "Yes, the pixels support the vine moth: it rests on the petiole."


@pytest.mark.parametrize("text", [JSON[:-1], JSON[:80], f"```json\n{JSON}", JSON[:-9] + "�", JSON[:60] + "…[+99]", "Answer: [12, 34", "y (truncated at 512 tokens by the gateway of this project)", SAID[:20] + " [truncated]", JSON[:50] + "   ​\n", '{"a": "x\\'])
def test_open_structures_are_cut(text):
    assert completeness.scan(text)[0]


@pytest.mark.parametrize("text", [JSON, f"```json\n{JSON}\n```", JSON.replace('"', "'").replace("true", "True").replace("null", "None"), JSON[:-1] + ",}", f"{JSON}\n{JSON}", f"{JSON}</s>", JSON + "   ", "", "  ", "don't stop [sic].", SAID])
def test_closed_structures_are_not_cut(text):
    cut, prose, _ = completeness.scan(text)
    assert not cut and all(p[2] or p[0] == "done" for p in prose if p[0] in ("yes,", "don't"))


@pytest.mark.parametrize("text", ["First line.<br>Second line ends here.", "The range is [0, 1) for all values.", "Use <name> as the label.", "Set x to {name} and go on.", "Some tips went brown (cut leaves were left out of the picture).", "It spans (length 5 mm).", "Open it with [ and close it later.", "He said 'well' and left.", "a < b and c > d.", "See note {1", "Wait..."])
def test_ordinary_text_is_no_certain_cut(text):
    assert not completeness.scan(text)[0]


def test_sound_json_needs_no_automaton():
    rng = random.Random(8)

    def value(depth):
        plain = lambda: rng.choice(["a b", "x", "", "né", 'q"\n', 7, None, True])
        some = lambda: {rng.choice("abc"): value(depth - 1) for _ in range(3)}
        many = lambda: [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return rng.choice([plain, some, many] if depth else [plain])()

    for _ in range(200):
        text = json.dumps({"k": value(3), "l": value(2)}, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        quick, slow = completeness.structure(text), completeness.structure(f"Answer: {text}")
        assert not quick.left_open and not slow.left_open and sorted(quick.values) == sorted(slow.values) and slow.end == len(text) + 8
    assert not completeness.structure("[" * 50_000 + "]" * 50_000).left_open and completeness.structure("[" * 50_000).left_open
    assert completeness.structure('{"a": "x"' + " " * 500 + ', "b": "y').left_open
    assert completeness.structure('{"a": "x"' + " " * 500 + ', "a": "y"}').values == [("a", "x"), ("a", "y")]


@pytest.mark.parametrize("size", [65, 1_000, 100_000])
def test_cut_values_of_any_length(spark, size):
    whole = "https://example.org/" + "ab/" * (size // 3) + "end"
    rows = [(f"w{i}", json.dumps({"link": whole, "n": i})) for i in range(6)] + [("cut", json.dumps({"link": whole[:size]})), ("other", json.dumps({"link": whole[: size - 1] + "!"})), ("field", json.dumps({"name": whole[:size]}))]
    df = spark.createDataFrame([(i, 1, "s", t) for i, t in rows], "id string, attempt int, source string, raw_text string")
    assert {r["id"] for r in completeness.cut_answers(df).collect()} == {"cut"}


def test_open_tags_are_held_against_their_source(spark):
    rows = [(f"a{i}", "m", f"<answer>Yes, moth {i}.</answer>") for i in range(9)] + [("cut", "m", "<answer>Yes, the moth is there.")]
    rows += [(f"b{i}", "n", f"Line {i}.<br>It ends here. <note>") for i in range(9)]
    df = spark.createDataFrame([(i, 1, s, t) for i, s, t in rows], "id string, attempt int, source string, raw_text string")
    assert {r["id"] for r in completeness.cut_answers(df).collect()} == {"cut"}


def test_cut_answers_by_baselines(spark):
    rows = [(f"a{i}", 1, "m", SAID) for i in range(3)] + [(f"b{i}", 1, "m", f"Yes, the pixels support the moth number {i}.") for i in range(20)]
    rows += [(f"c{i}", 1, "m", JSON.replace("3,4]", f"3,{i + 4}]")) for i in range(20)]
    rows += [("cut1", 1, "m", "Yes, the pixels support th"), ("cut2", 1, "n", JSON.replace("rolled margins", "rolled marg")), ("cut3", 2, None, JSON[:70] + "..."), ("cut3", 2, None, JSON[:70] + "..."), ("terse1", 1, "n", "supported: vine moth on the petiole"), ("terse2", 1, "n", "present = true, webbing near the petiole"), ("done", 1, "n", f"{JSON} done"), ("cut4", 1, "n", "Ye"), ("whole", 1, "n", "Yes"), ("null", 1, "n", None), ("empty", 1, "n", ""), ("long", 1, "n", "Yes, the moth. " * 5000)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "id string, attempt int, source string, raw_text string, text_id string, n string")
    assert {r["id"] for r in completeness.cut_answers(df).collect()} == {"cut1", "cut2", "cut3", "cut4"}
    report = {r["source"]: (r["answers"], r["cut_answers"]) for r in completeness.truncation_report(df).collect()}
    assert report == {"m": (44, 1), "n": (8, 2), None: (1, 1)}
    assert completeness.cut_answers(df.limit(0)).count() == 0


def test_baselines_are_those_of_the_source(spark):
    ended, plain = "The pale spots near leaf {} show the moth.", "The pale spots near leaf {} show the moth"
    rows = [(f"hot{i}", "hot", plain.format(i)) for i in range(200)] + [(f"full{i}", "full", ended.format(1000 + i)) for i in range(40)] + [("cut", "full", "The pale spots near leaf 7 show th")]
    rows += [(f"bare{i}", "bare", f"A few webs hang from stem {i}") for i in range(30)] + [(f"dot{i}", None, f"A few webs hang from stem {i + 100}.") for i in range(200)]
    rows += [("both1", "full", plain.format(9999)), ("both2", "hot", plain.format(9999)), ("few", "rare", "A few webs hang from ste")]
    df = spark.createDataFrame([(i, 1, s, t) for i, s, t in rows], "id string, attempt int, source string, raw_text string")
    assert {r["id"] for r in completeness.cut_answers(df).collect()} == {"cut", "both1", "few"}


Q = "Decide if the pest named 'vine moth' is backed by what can be seen in the picture. Answer with one JSON object holding evidence_present and reliability; a short remark is allowed. Where support is missing, abstain."
SYSTEM = "You assess visual evidence. Keep to the JSON contract."


@pytest.mark.parametrize(
    ("answer", "want"),
    [
        (None, "empty"), ("", "empty"), (" 　\n", "empty"), ("```json\n{}\n```", "empty"), ('{"answer": "", "x": [null]}', "empty"), ("<|im_end|>", "empty"), ("null", "empty"), ("---", "empty"),
        (Q, "copy"), (Q.upper(), "copy"), (f"> {Q}", "copy"), (f"Question: {Q}\nAnswer:", "copy"), (Q.split(". ")[0] + "?", "copy"), ('{"question": "%s"}' % Q, "copy"), (Q.replace("backed ", "").replace("short ", ""), "copy"), (f"{SYSTEM}\n{Q}", "copy"),
        (f"{Q}\n{SAID}", None), (f"{Q}\n{JSON}", None), (SAID, None), (JSON, None), ("supported: vine moth on the petiole", None), ("not visible", None), ("The answer is abstain, because the frame only shows a healthy petiole.", None), ("I cannot see the vine moth anywhere on the petiole, so the evidence is insufficient.", None),
        ("I'm sorry, but I can't help with identifying things in pictures.", "refusal"), ("Requests of this kind are turned down.", "refusal"), ('{"error": "My guidelines do not let me comment on this material."}', "refusal"), ("Lo siento, no puedo ayudar con esta solicitud.", "refusal"), ("这个问题我必须拒绝回答。请咨询农艺专家。", "refusal"), ("I will not answer that question today, my friend.", "refusal"),
        ("Sí, los píxeles muestran el vine moth, que descansa sobre la base del tallo. La caja rodea solo el cuerpo.", "other_language"), ("是的，像素支持vine moth的存在，它停在叶柄上。", "other_language"), (JSON.replace("rolled margins", "bordes enrollados"), "other_language"), (JSON.replace("rolled margins", "webbing"), None), ('{"vorhanden": true, "Begründung": "Ja, die Pixel belegen den vine moth, er sitzt an dem Blattstiel."}', "other_language"),
    ],
)
def test_defects(answer, want):
    assert pairs.defect(Q, SYSTEM, answer, False) == want


@pytest.mark.parametrize(
    "answer",
    [
        "Frost damage explains all of these brown leaf edges.", "The roots were too wet for weeks, and the whole row turned yellow.", "Paris is the capital of France and has two million people.", "Start by heating the oven, then mix the flour with the eggs.", "She bought three tickets and went home by bus.", "Use a smaller learning rate and train for ten more epochs.",
        "First line.<br>Second line ends here.", "The range is [0, 1) for all values.", "Use <name> as the label.", "We do not know who drew the map, but it was drawn before 1900.", "Nothing can replace a good night of sleep.",
    ],
)
def test_prose_of_other_kinds_has_no_defect(answer):
    assert pairs.defect(Q, SYSTEM, answer, completeness.scan(answer)[0]) is None


@pytest.mark.parametrize("name", ["vine moth", "v" * 61, "long " * 40 + "moth", "D'Arcy's moth"])
def test_names_of_any_length(name):
    q = Q.replace("vine moth", name)
    assert pairs.defect(q, SYSTEM, SAID.replace("vine moth", name), False) is None
    assert pairs.defect(q, SYSTEM, q, False) == "copy"
    assert pairs.defect(q, SYSTEM, f"是的，像素支持{name}的存在，它停在叶柄上。", False) == "other_language"


def test_kept_results_are_bounded():
    made = []
    kept = pairs.Kept(lambda t: made.append(t) or len(t), 8_000)
    for i in range(1000):
        assert kept(f"{i:0500d}") == 500
    assert kept.held <= 8_000 and len(kept.of) <= 14
    assert kept("x" * 5_000) == 5_000 and kept.held <= 8_000
    kept("y"), kept("y")
    assert made.count("y") == 1


def test_defect_of_other_questions():
    q = "Entscheide, ob der Schädling 'vine moth' durch das Bild belegt ist. Antworte mit einem JSON-Objekt; eine kurze Bemerkung auf Deutsch ist erlaubt."
    assert pairs.defect(q, "", "Ja, die Pixel belegen den vine moth, er sitzt an der Ranke. Der Kasten umfasst nur den Körper.", False) is None
    assert pairs.defect(q, "", SAID, False) == "other_language"
    assert pairs.defect(q, "", JSON[:40], True) == "truncated"


def test_suffix_automaton_equals_brute_force():
    rng = random.Random(2)
    for _ in range(30):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 25))) for _ in range(2))
        want = [max((k for k in range(i + 2) if b[i + 1 - k : i + 1] in a), default=0) for i in range(len(b))]
        assert pairs.SuffixAutomaton(a).runs(b) == want


def test_pair_defects_handles_odd_rows(spark):
    content = "array<struct<role:string,content:array<struct<type:string,text:string,image:string>>>>"
    msg = lambda q: None if q is None else [("system", [("text", SYSTEM, None)]), ("user", [("image", None, "x.jpg"), ("text", q, None), ("text", None, None)])]
    m = spark.createDataFrame([("1", msg(Q), "z"), ("1", msg(Q), "z"), ("2", msg("  　"), "z"), ("3", msg(None), "z"), ("4", [("user", None)], "z"), (None, msg(Q), "z")], f"id string, messages {content}, source string")
    p = spark.createDataFrame([("1", 1, "a", ""), ("1", 1, "a", ""), ("1", 2, None, Q), ("1", 3, "b", None), ("2", 1, "a", ""), ("3", 1, "a", ""), ("4", 1, "a", ""), ("9", 1, "a", ""), (None, 1, "a", ""), ("1", None, "a", "")], "id string, attempt int, source string, raw_text string")
    got = sorted(((r["id"], r["attempt"], r["defect"]) for r in pairs.pair_defects(m, p).collect()), key=repr)
    assert got == sorted([("1", 1, "empty"), ("1", 2, "copy"), ("1", 3, "empty"), ("1", None, "empty")], key=repr)
    assert pairs.pair_defects(m.limit(0), p).count() == 0 and pairs.pair_defects(m, p.limit(0)).count() == 0


def test_language_votes():
    assert language.vote("der Käfer sitzt an dem Blatt und frisst") == "de"
    assert language.vote("上周为三头") == "zh"
    assert language.vote("") is None and language.vote("12 34") is None
    assert language.vote("manchas prateadas galerias sinuosas") == "pt"
    assert language.vote("カメムシがいます") == "xx"


ODD = ["", None, " ", "\n\n  \t", "<|endoftext|> x", "a" * 3000, "ACGT" * 800, "naïve café № ½ ﷺ", "👩‍🌾🐛", "x=1;\n\tif (a<b) {return;}", "中文文本，没有空格", "don't we'll I'd", "​﻿", "0123456789" * 50, "   leading and trailing   ", "Ünï̈cödé " * 30]


def test_encoding_equals_public_tokenizers(spark):
    tokenizers = pytest.importorskip("tokenizers")
    tool = tokenizers.Tokenizer.from_file(tokens.RANKS.replace(".tiktoken", ".json"))
    tool.encode_special_tokens = True
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice(" abe\n'1.,é中\U0001f41b") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_texts(df).collect()}
    bpe = tokens.load()
    for i, t in enumerate(texts):
        assert got[i] == tool.encode(t or "", add_special_tokens=False).ids
        assert bpe.decode(got[i]) == (t or "")
    assert {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(df).collect()} == {i: len(v) for i, v in got.items()}
    assert tokens.encode_texts(df.limit(0)).count() == 0


def test_other_rank_file():
    path = tokens.RANKS.replace("byte_bpe_50k", "byte_bpe_multi_50k")
    bpe = tokens.load(path)
    for t in ODD:
        assert bpe.decode(bpe.encode(t)) == (t or "")


def test_best_two_fit_is_a_packing():
    rng = random.Random(6)
    for _ in range(20):
        cap = rng.randint(5, 200)
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(0, 150))]
        bins = packing.best_two_fit(sizes, cap)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= cap for b in bins)
    assert len(packing.best_two_fit([6, 4, 3, 3, 4], 10)) == 2  # 6+4 and 4+3+3
    assert packing.best_two_fit([], 10) == []


def test_pack(spark):
    rng = random.Random(7)
    sizes = {i: rng.choice([0, 1, 7, 50, 99, 100, 101, 250, 1000]) for i in range(300)}
    df = spark.createDataFrame([(i, None if i == 5 else n) for i, n in sizes.items()], "doc_id long, tokens int")
    sizes[5] = 0
    specs = spark.createDataFrame([("s", 100), ("l", 400), ("none", 0), ("s", 100)], "container_kind string, capacity_tokens int")
    for per in (40, 20_000):
        rows = packing.pack(df, specs, per).collect()
        for kind, cap in (("s", 100), ("l", 400)):
            mine = [r for r in rows if r["container_kind"] == kind]
            fill, held, pieces = {}, {}, {}
            for r in mine:
                fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["tokens"]
                held[r["doc_id"]] = held.get(r["doc_id"], 0) + r["tokens"]
                pieces[r["doc_id"]] = pieces.get(r["doc_id"], 0) + 1
            assert max(fill.values()) <= cap and held == sizes
            assert all(pieces[i] == 1 for i, n in sizes.items() if n <= cap)
            assert len(fill) <= 1.25 * sum(sizes.values()) / cap + 8
        assert {r["container_kind"] for r in rows} == {"s", "l"}
    report = {r["container_kind"]: r["used_share"] for r in packing.packing_report(packing.pack(df, specs)).collect()}
    assert report["l"] > 0.95
    assert packing.pack(df.limit(0), specs).count() == 0 and packing.pack(df, specs.limit(0)).count() == 0


def abusive(text):
    return abuse.document_score(text, abuse.model(), abuse.Reader())[0] >= abuse.THRESHOLD


def test_abuse_in_held_out_sentences():
    bad = [abusive(t) for b, _ in HELD_OUT.values() for t in b]
    good = [abusive(t) for _, g in HELD_OUT.values() for t in g]
    assert len(HELD_OUT) >= 10 and sum(bad) / len(bad) >= 0.9 and sum(good) / len(good) <= 0.05


def test_abuse_is_found_in_patterns_left_out():
    part = lambda t: int(hashlib.md5(t.encode()).hexdigest(), 16) % 4
    weights = abuse.train(abuse.training_documents(4000, 1, lambda t: part(t) == 0), rounds=150)
    rng, reader = random.Random(3), abuse.Reader()
    score = lambda t, lang: abuse.sentence_score(abuse.visible(abuse._fill(t, lang, rng)), weights, reader)
    bad = [score(t, lang) >= 0.5 for lang, ts in abuse.ABUSIVE.items() for t in ts if part(t) == 0]
    good = [score(t, lang) >= 0.5 for lang, ts in abuse.HARMLESS.items() for t in ts if part(t) == 0]
    assert sum(bad) / len(bad) > 0.8 and sum(good) / len(good) < 0.2


@pytest.mark.parametrize("text", ["You are a FucKiNg m\u200bo\u200br\u200bo\u200bn.", "he is the biggest \u0430sshоl\u0435 I ever met", "Go f**k yourself, and take your friends along", "1d10t", "You total m0r0n, you can't even count!", "you are an i d i o t and a loser", "you are such a stuuuupid liiiar", "The weather is fine. Verpiss dich, du Arschloch. Danke.", "你真是个白痴", "I will k1ll you tonight", "SHE IS A WORTHLESS BITCH!!!"])
def test_disguised_abuse(text):
    assert abusive(text)


@pytest.mark.parametrize("text", ["", None, "   ", "The cock crowed at four and the hens woke up.", "Kill every weevil before they spread.", 'The policy bans lines like "you are scum".', "This fucking rain ruined the party.", "Moths reached the lamp: 20 of them.", "x" * 20000, "12 455 455 3", "*** $$$ @@@ !!!", "f*", "The root of the book took root.", "ACGT" * 5000])
def test_harmless_texts(text):
    assert not abusive(text)


def test_long_harmless_documents_stay_harmless():
    assert not abusive("The vaccine kills the virus within hours. My stupid printer broke again. Our dog died last winter. " * 300)
    assert abusive("The vaccine kills the virus within hours. " * 300 + "You are a worthless piece of shit. " + "We met at the gate. " * 300)


def test_abuse_of_documents(spark):
    df = spark.createDataFrame([(1, "s", "Nothing to add. You are a stupid moron! Thanks.", "c"), (2, None, None, "c"), (3, "s", "", "c"), (4, "s", "Trap 4 held 3 adults. " * 400, "c")], "doc_id long, source string, text string, score string")
    got = {r["doc_id"]: r for r in abuse.score_documents(df).collect()}
    assert got[1]["score"] >= 0.5 and got[1]["sentence"] == "You are a stupid moron!" and got[2]["score"] == 0 and got[4]["score"] < 0.5
    assert [r["doc_id"] for r in abuse.abusive_documents(df).collect()] == [1]
    assert {r["source"]: (r["documents"], r["abusive"]) for r in abuse.abuse_report(df).collect()} == {"s": (3, 1), None: (1, 0)}
    assert abuse.score_documents(df.limit(0)).count() == 0
