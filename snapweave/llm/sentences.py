"""Sentence units of texts in many languages and scripts: a linear-chain model over characters, decoded by Viterbi.

Blank lines and list marks cut a text into blocks by rule. In a block each character is tagged *boundary* (the last of
its unit) or *inside*. Only characters that can end a sentence - a full stop or its like with the quotes and brackets
that close after it, or, in Thai and Lao, a letter before a blank - have a choice; all others are inside with certainty, so
the chain runs over the characters with a choice. Emissions are weights of local features (the mark, the words around
it, letter case and script, whether it stands in quotes or brackets and what led those in; at a blank of a script without
marks the letters on both sides and the length of what stands before and after it); transitions join adjacent
tags; a structured averaged perceptron learns both.

Labels come from the texts themselves: each list item is one unit by definition, so all its inner candidates are
inside and its end is a boundary. Training chains are items of one list put one after the other, with and without
blanks between. For scripts without full stops the marks are stripped from the items first, so that only letters and
blanks are left to learn from.

The training sample is bounded by ``max_texts`` texts and ``max_bytes`` bytes, those least by hash among all that hold a
list. With no list at all the model falls back to START_WEIGHTS. ``save_model`` and ``load_model`` keep a model, so that the
units of a document need not depend on what else is in its table. Null, empty and blank texts have no units. Very long texts are read whole.
"""

from __future__ import annotations

import json
import random
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapweave.operators.compaction import _files

MARKS = ".!?…。！？؟۔।॥．｡។៕။།༎"
PAIRS = {"“": "”", "‘": "’", "«": "»", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "〈": "〉", "‹": "›", "„": "“”", "‚": "‘’"}
CLOSERS = frozenset("”’»」』）)]】》〉›“‘\"'")
BRACKETS = frozenset("（([【")
#: Scripts whose sentences end without a full stop; candidates are blanks between their letters.
THAI = re.compile("[ก-ฺเ-๎ກ-ຼເ-ໍໜໝ]")
_LIST = re.compile(r"[^\S\n]*(?:[-*] |\d+[.)] )")
_SPACE = re.compile(r"\s+")
_CANDIDATE = re.compile(r"[" + re.escape(MARKS) + r"]+|[;;]|(?<=[ก-ฺเ-๎ກ-ຼເ-ໍໜໝ])\s+(?=[ก-ฺเ-๎ກ-ຼເ-ໍໜໝ])")
_PAIRED = re.compile("[" + re.escape("".join(PAIRS) + "".join(CLOSERS)) + "]")
_WORD = re.compile(r"[^\s“”‘’«»「」『』（）()\[\]【】《》〈〉„‚\"]+")
#: What the model begins with: marks end sentences outside quotes, before anything but a small letter.
START_WEIGHTS = {"m=.": 1.0, "m=!": 2.0, "m=blank": 2.0, "in": -4.0, "n=l": -2.0, "m=.|n=d": -1.0, "m=.|short": -1.0, "m=.|n=U": 1.0, "sb=0": -1.0}


_classes: dict[str, str] = {}


def char_class(c: str) -> str:
    """The class of a character, remembered."""
    out = _classes.get(c)
    if out is None:
        out = _classes[c] = _class_of(c)
    return out


def _class_of(c: str) -> str:
    if not c:
        return "end"
    o = ord(c)
    if c.isdigit():
        return "d"
    if c.isalpha():
        if c.isupper():
            return "U"
        if c.islower():
            return "l"
        if 0x0E00 <= o < 0x0F00:
            return "th"
        if 0x0900 <= o < 0x0980:
            return "dev"
        if 0x0600 <= o < 0x0780:
            return "ar"
        if 0xAC00 <= o < 0xD7B0:
            return "ko"
        return "cj"
    if c in PAIRS or c in "\"'":
        return "q"
    if c in "¿¡":
        return "U"
    return c if c in ",;:-–—" or unicodedata.category(c)[0] == "P" else "o"


def pairs_of(s: str) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Closing place -> opening place of the matched quotes and brackets in ``s``, and the spans, in order, inside the outermost of them."""
    stack: list[tuple[str, int]] = []
    closes: dict[int, int] = {}
    n = len(s)

    def close(kinds: str, at: int) -> bool:
        for k in range(len(stack) - 1, max(-1, len(stack) - 9), -1):
            if stack[k][0] in kinds:
                closes[at] = stack[k][1]
                del stack[k:]
                return True
        return False

    for m in _PAIRED.finditer(s):
        i, c = m.start(), m[0]
        if c == '"':
            if not close('"', i):
                stack.append((c, i))
        elif c == "'":
            before, after = s[i - 1] if i else " ", s[i + 1] if i + 1 < n else " "
            if not (not after.isalnum() and close("'", i)) and not before.isalnum() and after.isalnum():
                stack.append((c, i))
        elif c == "“":
            if not close("„", i):
                stack.append((c, i))
        elif c == "‘":
            if not close("‚", i):
                stack.append((c, i))
        elif c == "’":
            if not (i + 1 < n and s[i + 1].isalnum()):
                close("‘‚", i)
        elif c in PAIRS:
            stack.append((c, i))
        elif c in CLOSERS:
            close("“„" if c == "”" else next(o for o, e in PAIRS.items() if c in e), i)
    spans: list[tuple[int, int]] = []
    for o, e in sorted((o, e) for e, o in closes.items()):
        if not spans or o > spans[-1][1]:
            spans.append((o, e))
        elif e > spans[-1][1]:
            spans[-1] = (spans[-1][0], e)
    return closes, spans


def candidates(s: str) -> list[tuple[int, int, int, int | None]]:
    """Places in a block that may end a unit: (mark start, mark end, unit end with closers, opening place of the last closer or None)."""
    if not _CANDIDATE.search(s):
        return []
    closes, spans = pairs_of(s)
    out, n, k = [], len(s), 0

    def inside(at: int) -> bool:
        """Whether the place lies inside a pair; asked for in rising order."""
        nonlocal k
        while k < len(spans) and spans[k][1] < at:
            k += 1
        return k < len(spans) and spans[k][0] < at

    for m in _CANDIDATE.finditer(s):
        p, q = m.span()
        c = s[p]
        if c.isspace():
            out.append((p, p, p, None, inside(p)))
            continue
        if c in ";;":
            if not (p and "Ͱ" <= unicodedata.normalize("NFD", s[p - 1])[0] < "Ѐ") and not (p > 1 and s[p - 1] == " " and "Ͱ" <= s[p - 2] < "Ѐ"):
                if not _greek(s, p):
                    continue
        e, opened = q, None
        while e < n:
            if e in closes and s[e] in CLOSERS:
                opened, e = closes[e], e + 1
            elif s[e] in "   " and e + 1 < n and s[e + 1] in "»›" and e + 1 in closes:
                opened, e = closes[e + 1], e + 2
            else:
                break
        after = s[e : e + 1]
        if e == q and c == "." and (after.isdigit() or after.islower() or after in "/\\@_-,"):
            continue  # inside a number, version, file name or abbreviation
        out.append((p, q, e, opened, inside(min(e, n))))
    return out


def _greek(s: str, p: int) -> bool:
    """Whether the words before a semicolon are Greek, in which it is the question mark."""
    return sum("Ͱ" <= unicodedata.normalize("NFD", c)[0] < "Ѐ" for c in s[max(0, p - 40) : p]) >= 6


_shapes: dict[str, str] = {}


def _shape(word: str) -> str:
    """The word with its digits as one 9."""
    out = _shapes.get(word)
    if out is None:
        if len(_shapes) > 100_000:
            _shapes.clear()
        out = _shapes[word] = re.sub(r"\d+", "9", word)
    return out


def _log2(n: int) -> int:
    return n.bit_length()


def properties(s: str, cand: tuple) -> tuple:
    """What the features of a candidate are made of; few different ones, so scores can be remembered by them."""
    p, q, e, opened, inside = cand
    n = len(s)
    k = e
    while k < n and s[k].isspace():
        k += 1
    nxt = s[k : k + 1]
    if p == q:
        before, after = s.rfind(" ", 0, p), s.find(" ", k)
        return ("blank", inside, char_class(nxt), s[max(0, p - 2) : p], s[k : k + 2], _log2(p - before), _log2((n if after < 0 else after) - k))
    cls, blank = char_class(nxt), "1" if k > e else "0"
    run = s[p:q]
    mark = "..." if "…" in run or run.startswith("..") else "." if run == "." else "!" if run[0] in "!?؟;;" else "。"
    word = short = before = following = ""
    kind = "-"
    if mark in "...":
        found = list(_WORD.finditer(s, max(0, p - 32), p))
        if found and found[-1].end() == p:
            word = found.pop()[0]
            before = _shape(found[-1][0]).lower()[-9:] if found else "<"
            head, dot, tail = word.rpartition(".")
            if dot and tail.isalpha() and len(head) > 3 and head[-3:].isalpha():
                word = tail  # a sentence that begins without a blank
        shape = _shape(word)
        short = shape.lower() if len(shape) <= 9 else ("FILE" if "9." in shape else "long")
        if mark == ".":
            kind = "9" if short and short[-1] == "9" else "one" if len(word) == 1 else "short" if len(word) <= 3 else "Long" if word[0].isupper() else "long"
            if len(word) == 1 and word.isupper():
                kind = "ONE"
        word = word.lower()
    if not inside:
        if cls in ("cj", "th", "dev", "ar", "ko"):
            following = "~"
        else:
            w = _WORD.match(s, k, min(n, k + 12))
            following = _shape(w[0]).lower() if w else nxt
    lead = what = ""
    if opened is not None and not inside:
        b = opened - 1
        while b >= 0 and s[b].isspace():
            b -= 1
        lead = "start" if b < 0 else ":" if s[b] in ":：" else "," if s[b] in ",，、،" else "start" if s[b] in MARKS or s[b] in CLOSERS else "mid"
        what = "br" if s[opened] in BRACKETS else "qu"
    return (mark, inside, cls, blank, kind, short, word if mark == "." else "", before if mark == "." else "", following, opened is not None, lead, what)


def parts_of(props: tuple, plain: dict | frozenset = frozenset()) -> list[tuple]:
    """The properties in small groups, each of which makes some features; there are far fewer different groups than candidates.
    ``plain`` holds "plain:word" for words known to stand without a full stop, "bare:word" for other known ones."""
    if props[0] == "blank":
        _, inside, cls, left, right, size_before, size_after = props
        return [("B", inside, cls), ("L", left), ("R", right), ("S", left[-1:], right[:1]), ("N", size_before, size_after)]
    mark, inside, cls, blank, kind, short, word, before, following, quoted, lead, what = props
    out: list[tuple] = [("A", mark, inside, cls, blank, kind, lead, what)]
    if not inside:
        out += [("W", short, mark, cls), ("F", following, mark, quoted)]
        if mark == ".":
            out += [("V", before, kind, cls), ("E", short, following)]
            if kind not in ("9", "one", "ONE"):
                known = "plain" if "plain:" + word in plain else "bare" if "bare:" + word in plain else "unknown"
                out.append(("K", known, kind, cls))
    return out


def features_of_part(part: tuple) -> list[str]:
    what, *x = part
    if what == "B":
        return ["b", "m=blank", *(["in"] if x[0] else []), f"blank|{x[1]}"]
    if what == "L":
        return [f"l1={x[0][-1:]}", f"l2={x[0]}"]
    if what == "R":
        return [f"r1={x[0][:1]}", f"r2={x[0]}"]
    if what == "S":
        return [f"lr={x[0]}{x[1]}"]
    if what == "N":
        return [f"n<{x[0]}", f"n>{x[1]}"]
    if what == "W":
        return [f"w={x[0]}|{x[1]}", f"w={x[0]}|{x[1]}|n={x[2]}"]
    if what == "F":
        return [f"f={x[0]}|{x[1]}|{x[2]}"]
    if what == "V":
        return [f"v={x[0]}|{x[1]}", f"v={x[0]}|{x[1]}|n={x[2]}"]
    if what == "E":
        return [f"w={x[0]}|f={x[1]}"]
    if what == "K":
        return [f"{x[0]}|{x[1]}", f"{x[0]}|n={x[2]}", f"{x[0]}|{x[1]}|n={x[2]}"]
    mark, inside, cls, blank, kind, lead, pair = x
    out = ["b", f"m={mark}", f"n={cls}", f"m={mark}|n={cls}", f"m={mark}|n={cls}|{blank}", f"m={mark}|{kind}", f"m={mark}|{kind}|n={cls}", f"sb={blank}"]
    if inside:
        out += ["in", f"in|{mark}"]
    elif kind in ("short", "one"):
        out.append("m=.|short")
    if pair:
        out += [f"{pair}|{lead}", f"{pair}|{lead}|n={cls}", f"{pair}|{lead}|n={cls}|{blank}", f"{pair}|n={cls}"]
    return out


def features(s: str, cand: tuple, plain: dict | frozenset = frozenset()) -> list[str]:
    return [f for part in parts_of(properties(s, cand), plain) for f in features_of_part(part)]


def viterbi(emit: list[float], trans: dict[str, float]) -> list[int]:
    """Best tags (1 boundary, 0 inside) of a chain with the given boundary scores; inside scores are 0."""
    t = {k: trans.get(k, 0.0) for k in ("t00", "t01", "t10", "t11")}
    a, b = 0.0, float("-inf")  # best score ending inside, ending on a boundary; a chain begins inside
    back = []
    for x in emit:
        a0, a1, b0, b1 = a + t["t00"], b + t["t10"], a + t["t01"] + x, b + t["t11"] + x
        back.append((a1 > a0, b1 > b0))
        a, b = max(a0, a1), max(b0, b1)
    tag = int(b > a)
    out = []
    for pa_, pb in reversed(back):
        out.append(tag)
        tag = int(pb if tag else pa_)
    return out[::-1]


def score(weights: dict[str, float], feats: list[str]) -> float:
    get = weights.get
    return sum([get(f, 0.0) for f in feats])


class Scorer:
    """Scores of candidates under fixed weights, remembered by the groups of their properties."""

    def __init__(self, weights: dict[str, float], most: int = 400_000):
        self.weights, self.known, self.most = weights, {}, most

    def __call__(self, s: str, cand: tuple) -> float:
        known, total = self.known, 0.0
        for part in parts_of(properties(s, cand), self.weights):
            x = known.get(part)
            if x is None:
                if len(known) >= self.most:
                    known.clear()
                x = known[part] = score(self.weights, features_of_part(part))
            total += x
        return total


def blocks(text: str) -> Iterator[tuple[int, int, bool]]:
    """(start, end, is a list item) of the blocks of a text: paragraphs, headings, list items."""
    start, item, at = None, False, 0
    for line in text.split("\n"):
        end = at + len(line)
        if not line or line.isspace():
            if start is not None:
                yield start, at - 1, item
            start = None
        elif _LIST.match(line):
            if start is not None:
                yield start, at - 1, item
            start, item = at, True
        elif start is None:
            start, item = at, False
        at = end + 1
    if start is not None:
        yield start, len(text), item


def split_units(text: str, weights: dict[str, float], scorer: Scorer | None = None) -> list[tuple[int, int]]:
    """Code point offsets of the sentence units of ``text``."""
    scorer = scorer or Scorer(weights)
    out: list[tuple[int, int]] = []

    def put(a: int, b: int) -> None:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))

    for start, end, item in blocks(text or ""):
        begin = start
        if not item:
            s = text[start:end]
            chain = candidates(s)
            if chain:
                for cand, tag in zip(chain, viterbi([scorer(s, c) for c in chain], weights)):
                    if tag:
                        put(begin, start + cand[2])
                        begin = start + cand[2]
        put(begin, end)
    return out


def plain_words(texts: list[str]) -> dict[str, float]:
    """"plain:word" of the words that stand before a blank or comma, without a full stop, at least half as often as with one; "bare:word" of the rest."""
    bare: dict[str, int] = defaultdict(int)
    for text in texts:
        for m in re.finditer(r"([^\W\d_]{2,12})([.]?)(?=[\s,])", text):
            bare[m[1].lower()] += -1 if m[2] else 2
    return {f"{'plain' if n > 0 else 'bare'}:{w}": 0.0 for w, n in bare.items()}


def training_chains(texts: list[str], seed: int = 7, plain: dict | frozenset = frozenset()) -> list[tuple[list[list[str]], list[int]]]:
    """Feature lists and tags of chains made of the list items in ``texts``."""
    rng = random.Random(seed)
    lists: list[list[str]] = []
    for text in texts:
        now: list[str] = []
        for start, end, item in blocks(text):
            line = _SPACE.sub(" ", text[start:end]).strip()
            line = line[_LIST.match(line + " ").end() :].strip() if item and _LIST.match(line + " ") else line
            if item and line:
                now.append(line)
            elif now:
                lists.append(now)
                now = []
        if now:
            lists.append(now)
    chains = []
    for items in lists:
        if len(THAI.findall("".join(items))) * 2 > sum(c.isalpha() for c in "".join(items)):
            items = [x.translate({ord(c): None for c in MARKS if c != "."}).strip() for x in items]
        for _ in range(2):
            order = items[:]
            rng.shuffle(order)
            s, ends = "", set()
            for x in order:
                if s:
                    tight = s[-1] in "。！？」』”）…" and char_class(x[0]) in ("cj", "q") or s[-1] not in THAI_SET and rng.random() < 0.08
                    s += "" if tight else " "
                s += x
                ends.add(len(s))
            cand = candidates(s)
            if cand:
                chains.append(([features(s, c, plain) for c in cand], [int(c[2] in ends) for c in cand]))
    return chains


THAI_SET = frozenset(chr(o) for o in range(0x0E01, 0x0E4F))


def train(texts: list[str], epochs: int = 5, seed: int = 7) -> dict[str, float]:
    """Weights of features and transitions by the structured averaged perceptron, from the list items in ``texts``."""
    plain = plain_words(texts)
    chains = training_chains(texts, seed, plain)
    if not chains:
        return dict(START_WEIGHTS)
    # features by number while training
    number: dict[str, int] = {}
    numbered = [([[number.setdefault(f, len(number)) for f in x] for x in full], gold) for full, gold in chains]
    names = list(number)
    weight, total = [START_WEIGHTS.get(f, 0.0) for f in names], [0.0] * len(names)
    of_words = [f[:2] in ("w=", "f=", "v=") for f in names]
    trans: dict[str, float] = defaultdict(float)
    trans_total: dict[str, float] = defaultdict(float)
    rng, step = random.Random(seed), 1
    for _ in range(epochs):
        rng.shuffle(numbered)
        for full, gold in numbered:
            # words are left out now and then, so that the general features carry unknown words
            feats = [[f for f in x if not of_words[f]] if rng.random() < 0.25 else x for x in full]
            guess = viterbi([sum([weight[f] for f in x]) for x in feats], trans)
            step += 1
            if guess == gold:
                continue
            before_g = before_t = 0
            for x, g, t in zip(feats, guess, gold):
                if g != t:
                    d = 1.0 if t else -1.0
                    for f in x:
                        weight[f] += d
                        total[f] += d * step
                if (before_g, g) != (before_t, t):
                    for key, d in ((f"t{before_t}{t}", 1.0), (f"t{before_g}{g}", -1.0)):
                        trans[key] += d
                        trans_total[key] += d * step
                before_g, before_t = g, t
    out = {f: w - x / step for f, w, x in zip(names, weight, total)} | {f: w - trans_total[f] / step for f, w in trans.items()}
    return plain | {f: w for f, w in (START_WEIGHTS | out).items() if abs(w) > 1e-9}


def training_sample(docs: DataFrame, id_col: str, text_col: str, max_texts: int, max_bytes: int = 32 << 20) -> list[str]:
    """At most ``max_texts`` texts, of at most ``max_bytes`` together, that hold a list: those least by hash of id and text. A text
    larger than a 64th of the bytes is no sample."""
    text = F.col(f"`{text_col}`")
    own = docs.where(F.octet_length(text) <= max_bytes // 64).where(text.rlike(r"(?m)^[ \t]*([-*] |\d+[.)] )")).select(text.alias("t"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("h"))
    n = own.count()
    if n > 4 * max_texts:
        # twice as many as needed on average: every task hands on few rows, however many tasks there are
        own = own.where(F.col("h") < F.lit(int((2 * max_texts / n - 0.5) * 2**64)))
    total = F.sum(F.octet_length("t")).over(Window.orderBy("h", "t").rowsBetween(Window.unboundedPreceding, 0))
    return [r["t"] for r in own.orderBy("h", "t").limit(max_texts).withColumn("n", total).where(F.col("n") <= max_bytes).orderBy("h", "t").collect()]


def save_model(weights: dict[str, float], uri: str) -> None:
    fs, path = _files(uri)
    with fs.open_output_stream(path) as f:
        f.write(json.dumps(weights, ensure_ascii=False, sort_keys=True).encode())


def load_model(uri: str) -> dict[str, float]:
    fs, path = _files(uri)
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def sentence_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_texts: int = 4000, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, start_char, end_char) for each sentence unit. Repeated rows give repeated units; further columns are ignored."""
    model = weights if weights is not None else train(training_sample(docs, id_col, text_col, max_texts))
    kind = docs.schema[id_col].dataType.simpleString()
    own = docs.where(F.col(f"`{text_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            ids, starts, ends = [], [], []
            for i, (one, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                units = split_units(text, model, scorer)
                ids += [one] * len(units)
                starts += [u[0] for u in units]
                ends += [u[1] for u in units]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[id_col, "start_char", "end_char"])

    return own.mapInArrow(run, f"`{id_col}` {kind}, start_char int, end_char int")
