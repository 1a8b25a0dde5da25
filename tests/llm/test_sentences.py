import pytest

from snapweave.llm import sentences as S

ENGLISH = ["Dr. Lane read the log at 5 p.m. on a Monday.", "Use list-1.tmp or pack-2.log.", "“Is it the lock?” asked Ann, “or the pack?”", "Version 1.2.3 (released Jan. 2) failed.", "Not even the tree survived?!", "See No. 7 of the guide, i.e. the last part.",
           "Wait... is the index gone?", 'The operator asked: "Is it safe? Can we go on?"', "We keep the lock, the pack, etc.", "Nobody at Lane Ltd. had checked it.", "The (old) cache is read-only.", "Mr. Lane moved it."]
CHINESE = ["文件pack-1.idx里保存了快照。", "安问：“索引在哪里？”", "「仓库还在吗？」管理员问。", "不要删除缓存！", "大小为9.5GB（见第3章）的清单很常见。"]
THAI = ["อย่าลบสำเนาเด็ดขาด", "แฟ้ม a-1.tmp เก็บกุญแจของ Ann ไว้แล้ว", "ทำไมรายการจึงมีขนาด 4.8 กิกะไบต์ครับ", "หลังจาก 5 ครั้งดัชนีก็กลับมา"]


def listed(items):
    return "\n".join(f"- {x}" for x in items)


@pytest.fixture(scope="module")
def model():
    return S.train([listed(x[i:] + x[:i]) for x in (ENGLISH, CHINESE, THAI) for i in range(len(x))], epochs=12)


def texts(s, model):
    return [s[a:b] for a, b in S.split_units(s, model)]


def test_joined_sentences_come_apart(model):
    for items, sep in ((ENGLISH, " "), (CHINESE, ""), (THAI, " ")):
        assert texts(sep.join(items), model) == items
        assert texts(sep.join(reversed(items)), model) == items[::-1]


def test_blocks(model):
    s = "A heading\n \nUse it.\tMr. Lane\nmoved it.\n\n1) First. Still first.\n2) Second\n* third one\n\n\n  - last  \n"
    assert texts(s, model) == ["A heading", "Use it.", "Mr. Lane\nmoved it.", "1) First. Still first.", "2) Second", "* third one", "- last"]


@pytest.mark.parametrize("s", ["", " \n\t\n ", None])
def test_no_units(model, s):
    assert S.split_units(s, model) == []


def test_units_leave_out_only_whitespace(model):
    s = "“Odd «quotes (never closed. And! more? \n\n" + " ".join(ENGLISH) * 50 + "." * 3000
    units = S.split_units(s, model)
    at = 0
    for a, b in units:
        assert at <= a < b and not s[at:a].strip() and s[a:b] == s[a:b].strip()
        at = b
    assert not s[at:].strip()


def test_pairs():
    closes, spans = S.pairs_of("a \"b\" (c 'd') l'e „f“ “g” « h »")
    assert len(closes) == 6 and spans == [(2, 4), (6, 12), (18, 20), (22, 24), (26, 30)]
    assert S.pairs_of("1) no )( pairs \" here")[0] == {}


def test_viterbi_is_the_best_chain():
    from itertools import product

    trans = {"t00": 0.3, "t01": -0.2, "t10": 0.1, "t11": -1.0}
    emit = [0.5, 0.9, -0.4, 1.2]

    def value(tags):
        return sum(trans[f"t{a}{b}"] for a, b in zip((0, *tags), tags)) + sum(e for e, t in zip(emit, tags) if t)

    assert tuple(S.viterbi(emit, trans)) == max(product((0, 1), repeat=4), key=value)


def test_operator(spark, model):
    docs = spark.createDataFrame([(1, "Use it. Mr. Lane moved it."), (2, None), (3, ""), (4, listed(ENGLISH)), (1, "Use it. Mr. Lane moved it.")], "doc_id long, text string").selectExpr("*", "0 as start_char", "'x' as id")
    rows = S.sentence_units(docs, weights=model).collect()
    assert sorted((r["start_char"], r["end_char"]) for r in rows if r["doc_id"] == 1) == [(0, 7), (0, 7), (8, 26), (8, 26)]
    assert len([r for r in rows if r["doc_id"] == 4]) == len(ENGLISH)
    trained = S.sentence_units(docs).collect()
    assert len([r for r in trained if r["doc_id"] == 4]) == len(ENGLISH)
    assert S.sentence_units(docs.limit(0)).collect() == []
    assert S.train([]) == S.START_WEIGHTS


def test_blanks_of_scripts_without_marks_have_context():
    """Thai and Lao have no marks to go by: the letters and lengths around a blank are features, and training leaves only them."""
    s = "แมวนอน หมากิน"
    (cand,) = S.candidates(s)
    assert {"l1=น", "l2=อน", "r2=หม", "lr=นห", "n<3", "n>3"} <= set(S.features(s, cand))
    assert len(S.candidates("ແມວນອນ ໝາກິນ")) == 1 and S.candidates("ab cd") == []
    weights = S.train(["\n".join(f"- {x}." for x in ("แมวนอนที่บ้าน", "หมากินข้าว", "นกบินสูง"))] * 5)
    assert S.split_units("นกบินสูง แมวนอนที่บ้าน", weights) == [(0, 8), (9, 22)]


def test_scores_are_those_of_the_features():
    weights = {f: (hash(f) % 97) / 10 for f in ("b", "m=.", "n=U", "w=etc|.", "v=and|short", "unknown|short", "f=the|.|False", "n=l", "m=!")}
    scorer = S.Scorer(weights, most=5)
    for s in ("this and etc. The end! no. 5 v. 3.", "„Is it?“ he said. (Yes.) No."):
        for cand in S.candidates(s):
            assert abs(scorer(s, cand) - S.score(weights, S.features(s, cand, weights))) < 1e-9


def test_the_sample_is_bounded_and_models_are_kept(spark, tmp_path):
    rows = [(i, f"- item {i}\n- other {i}") for i in range(50)] + [(99, "- " + "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(S.training_sample(docs, "doc_id", "text", 10)) == 10
    few = S.training_sample(docs, "doc_id", "text", 100, max_bytes=64 * 30)
    assert 0 < sum(len(t) for t in few) <= 64 * 30 and all(len(t) < 64 for t in few)
    S.save_model({"b": 1.5, "é": -2.0}, str(tmp_path / "model.json"))
    assert S.load_model(str(tmp_path / "model.json")) == {"b": 1.5, "é": -2.0}
