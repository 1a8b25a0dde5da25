import random

import numpy as np

from snapweave.llm import contamination as C

PASSAGE = "The spare tree Woroly delayed the foreign lock Creaneck too early despite eight warnings and the early cache Plounen mirrored the other tree at night after round six hundred"
ZH = "备用的缓存靠近第二百块部分地追上了旧索引新的快照负载为二十五时缓慢地核对了目录树灰色的数据块拆分了清单"
ITEMS = [(1, "en", "Read this.\n\n" + PASSAGE), (2, "zh", "Read this.\n\n" + ZH), (3, "en", "Read this.\n\n"), (4, "en", None), (5, "fr", "Lis.\n\nUn café très spécial gardait une vieille clé dorée près du grand château de pierre grise")]


def found(spark, texts, items=ITEMS, **how):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'x' as item_id", "1 as id", "2 as grams", "3 as gram", "'y' as lang", "4 as n")
    rows = C.find_contamination(docs, spark.createDataFrame(items, "item_id long, lang string, text string"), **how)
    return sorted((r["doc_id"], r["item_id"]) for r in rows.collect())


def test_forms_parts_and_changes(spark, monkeypatch):
    w = PASSAGE.split()
    texts = [
        PASSAGE,
        "intro " + PASSAGE.upper().replace(" ", " - \n") + " outro",
        " ".join(w[:13]),  # two fifths
        " ".join(w[:6]) + " other things between them here " + " ".join(w[12:18]),  # stretches below eight words
        " ".join("x" if i % 7 == 3 else x for i, x in enumerate(w)),  # changed words do not end stretches
        " ".join("x" if i % 3 == 1 else x for i, x in enumerate(w)),  # every third one
        " ".join("x" if i % 2 == 1 else x for i, x in enumerate(w)),  # a text of the same pattern with other words in it
        "Read this.",
        "", None,
        ZH.replace("的", "的 ，"),
        ZH[:12] + "无关的内容写在这里" + ZH[30:40],
        "un cafe tres special gardait, une VIEILLE cle doree pres du grand chateau",
        "Un café très spécial gardait une vieille clé dorée près",
        "Ｕｎ café très spécial gardait une vieille clé dorée près",
        ("filler words stand here " * 20_000) + PASSAGE,
        PASSAGE + "\n" + ZH,
    ]
    want = [(0, 1), (1, 1), (2, 1), (4, 1), (5, 1), (10, 2), (12, 5), (13, 5), (14, 5), (15, 1), (16, 1), (16, 2)]
    assert found(spark, texts) == want
    # without the set of the items' n-grams, and without broadcasts, the joins alone find the same
    monkeypatch.setattr(C, "BROADCAST_LIMIT", 0)
    assert found(spark, texts, filter_bytes=0) == want


def test_empty_inputs(spark):
    assert found(spark, []) == [] and found(spark, [PASSAGE], []) == []


def test_common_passages_keep_seeds(spark):
    assert len(found(spark, [PASSAGE] * 50)) == 50


def naive(a, b):
    """Best score of one local alignment, cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1][j + 1] = max(0, h[i][j] + (C.MATCH if a[i] == b[j] else C.MISMATCH), h[i][j + 1] + C.GAP, h[i + 1][j] + C.GAP)
            best = max(best, h[i + 1][j + 1])
    return best


def test_bands_align_like_the_whole_matrix():
    rng = random.Random(3)
    for _ in range(60):
        a = np.array([rng.randint(10, 40) for _ in range(rng.randint(12, 40))], np.uint64)
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice([[], [99], [b[k], 98]])
        b = np.array([rng.randint(50, 60) for _ in range(6)] + b + [rng.randint(50, 60) for _ in range(5)], np.uint64)
        path = C.align_bands([a, a[:3]], [b, b], np.array([6, 0]))[0]
        assert all(a[i] == b[j] for i, j in path) and all(x < y and v < w for (x, v), (y, w) in zip(path, path[1:]))
        if naive(a, b) > C.THRESHOLD:
            score = C.MATCH * len(path)
            for (i, j), (x, y) in zip(path, path[1:]):
                di, dj = x - i - 1, y - j - 1
                score += C.MISMATCH * min(di, dj) + C.GAP * abs(di - dj)
            assert score >= naive(a, b) - C.THRESHOLD


def test_alignment_finds_gaps_and_goes_on_after_other_text():
    a, b = np.arange(12, dtype=np.uint64) + 5, np.array([99, 0, 1, 2, 3, 98, 4, 5, 6, 8, 9, 10, 11, 97], np.uint64) + np.uint64(5)
    assert [i for i, _ in C.align_bands([a], [b], np.array([1]))[0]] == [0, 1, 2, 3, 4, 5, 6, 8, 9, 10, 11]
    a = np.arange(60, dtype=np.uint64) + 100
    b = a.copy()
    b[20:40] = 7
    assert [i for i, _ in C.align_bands([a], [b], np.array([0]))[0]] == [*range(20), *range(40, 60)]


def marked(runs, kind):
    path, i, mark = [], 0, np.zeros(200, bool)
    for r in runs:
        path += [(k, k) for k in range(i, i + r)]
        i += r + 1
    C.covered(path, kind, mark)
    return int(mark.sum())


def test_stretches():
    assert marked([8], "w") == 8 and marked([7], "w") == 0 and marked([4, 4], "w") == 9
    assert marked([2] * 6, "w") == 17 and marked([1] * 20, "w") == 0
    assert marked([16], "c") == 16 and marked([15], "c") == 0 and marked([9, 9], "c") == 19 and marked([4] * 10, "c") == 0


def test_tokens_are_those_of_plain_text():
    texts = ["Éa, ß\tΣΣ ＡＢ１ ﬁn", "", "  ", "한국어 텍스트", "क्षेत्र नमस्ते", "x" * 5000 + " y", "ab ba", "c\u0000d e\u0301e"]
    folder = C.Folder()
    for kind in "wc":
        tokens, start = folder.tokens(texts, kind)
        seen = {}
        for t, a, b in zip(texts, start, start[1:]):
            own = C.plain(t).split() if kind == "w" else list(C.plain(t).replace(" ", ""))
            assert len(own) == b - a
            for w, h in zip(own, tokens[a:b].tolist()):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_plain():
    assert C.plain("Éa, ß\tΣΣ ＡＢ１").split() == ["ea", "ss", "σσ", "ab1"]
    assert C.passage("line\n \t\nrest\n\nmore") == "rest\n\nmore" and C.passage("only") == "only"
