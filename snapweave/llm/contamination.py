"""Evaluation texts in training texts: rare n-gram seeds join documents to items, Smith-Waterman alignment scores the pairs.

Texts are compared as sequences of words - of characters in scripts without blanks - after compatibility decomposition,
with case, combining marks, punctuation and blanks gone. The steps:

1. n-grams: the corpus is folded and hashed once, in whole Arrow batches. Words have three patterns (three in a row, and three
   of four with the second or third left open), so that texts with every third word changed still share some; characters
   have runs of six. Documents with an n-gram of some item are written with those n-grams. Which n-grams the items have is
   told to the tasks as a set of 8 bytes each, if that stays below ``filter_bytes``; beyond it documents keep all of theirs.
2. seeds: the documents with each n-gram are counted, and of each two neighbouring n-grams of an item the rarer one becomes
   a seed, so however common a passage is, each run that leaves two neighbouring n-grams keeps a seed.
3. join: documents and items meet on the hash of a seed. No pair is left out before it is aligned.
4. alignment: the n-grams a pair shares lie on diagonals; around each cluster of them a band is aligned by Smith-Waterman
   with repeated matches, many bands at a time. A band costs (words of the item) x (width of the band), however long the
   document is.

A stretch is what a local alignment leaves: equal words count 1 each, a changed word (up to ``WORD_CHARS`` changed
characters) costs ``COST``, and a stretch goes on as long as what follows pays for that: texts of one pattern with other
words in it do not. Stretches with ``LEAST`` equal words (characters) count; the share of the item they cover is reported.

Nothing caps the documents of an item or the items of a document. Null and empty texts match nothing; an item with fewer
words than a stretch needs matches nothing; repeated documents are reported once per id. Texts are used whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapweave.session import BROADCAST_LIMIT, maybe_broadcast, written

#: Patterns of the n-grams of words, and the length of those of characters.
PATTERNS, CHARS = ((0, 1, 2), (0, 1, 3), (0, 2, 3)), 6
#: An isolated change of one word may change this many characters.
WORD_CHARS = 9
#: By kind (words, characters): equal ones a stretch needs, cost of a change, places a change may take.
LEAST, COST, JUMP = {"w": 8, "c": 16}, {"w": 1, "c": 6}, {"w": 1, "c": WORD_CHARS}
#: Places of the item that the n-grams in a band must cover for it to be aligned: every stretch leaves as many, unless it has
#: words put in or left out more often than every third word.
SPREAD = {"w": 5, "c": 12}
#: Half the width of a band, and the scores of the alignment.
HALF, MATCH, MISMATCH, GAP, THRESHOLD = 12, 2, -1, -2, 10
_BLANKS = re.compile(r"\n[^\S\n]*\n")
_UNSEEN, _MANY, _END, _BLANK = 0x7FFFFFFF, 0x7FFFFFFE, 1, 32
_MUL = np.random.default_rng(4).integers(1, 1 << 63, (len(PATTERNS) + 1, CHARS), dtype=np.uint64) | np.uint64(1)


class _Fold(dict):
    """Code point -> its compared form."""

    def __missing__(self, point: int) -> str:
        out = []
        for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", chr(point)).casefold()):
            kind = unicodedata.category(c)
            if kind[0] in "LN" or kind == "Mc":
                out.append(c)
            elif kind not in ("Mn", "Me", "Cf"):
                out.append(" ")
        self[point] = "".join(out)
        return self[point]


_FOLD = _Fold()


def plain(text: str) -> str:
    """Text with case, accents, width and punctuation gone; what separates words is one blank or more."""
    return text.translate(_FOLD)


def passage(text: str) -> str:
    """The item without its instruction line: what follows the first blank line, or all of it."""
    m = _BLANKS.search(text)
    return text[m.end() :] if m else text


def kind_of(lang: str | None) -> str:
    return "c" if (lang or "").strip().lower() in ("zh", "ja", "th") else "w"


class Folder:
    """Texts to arrays of tokens: the same folding as ``plain``, for many texts at a time."""

    def __init__(self):
        self.one = np.full(0x110001, _UNSEEN, np.uint32)
        self.one[0x110000] = _END
        self.size, self.start, self.parts = np.ones(0x110001, np.uint8), np.zeros(0x110001, np.int64), np.zeros(0, np.uint32)
        self.power, self.inverse = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _codes(self, points: np.ndarray) -> np.ndarray:
        out = self.one[points]
        if (new := out == _UNSEEN).any():
            for c in np.unique(points[new]).tolist():
                s = _FOLD[c]
                self.one[c] = 0 if not s else ord(s) if len(s) == 1 else _MANY
                if len(s) > 1:
                    self.size[c], self.start[c] = len(s), len(self.parts)
                    self.parts = np.append(self.parts, np.array([ord(x) for x in s], np.uint32))
            out = self.one[points]
        if (many := out == _MANY).any():
            sizes = self.size[points].astype(np.int64)
            sizes[~many] = 1
            wide = np.repeat(out, sizes)
            n = sizes[many]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            wide[np.repeat(many, sizes)] = self.parts[np.repeat(self.start[points[many]], n) + inside]
            out = wide
        return out[out != 0]

    def _powers(self, n: int) -> None:
        """Powers of an odd base and of its inverse modulo 2^64, up to n."""
        if len(self.power) < n:
            base = 0x9E3779B97F4A7C15
            for name, x in (("power", base), ("inverse", pow(base, -1, 1 << 64))):
                factors = np.full(n + n // 2, x, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    def tokens(self, texts: list[str], kind: str) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of all tokens, place of the first token of each text and the end)."""
        end = np.array([0x110000], np.uint32)
        codes = self._codes(np.concatenate([x for t in texts for x in (np.frombuffer(t.encode("utf-32-le"), np.uint32), end)]))
        last = codes == _END
        gap = last | (codes == _BLANK)
        text_of = np.cumsum(last) - last
        real = ~gap
        if kind == "c":
            h = codes[real].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            return h ^ (h >> np.uint64(32)), np.searchsorted(text_of[real], np.arange(len(texts) + 1))
        first = real.copy()
        first[1:] &= gap[:-1]
        starts = np.flatnonzero(first[real])
        if not len(starts):
            return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
        letters = codes[real].astype(np.uint64)
        self._powers(len(letters))
        letters += np.uint64(0x632BE5AB)
        letters *= self.power[: len(letters)]
        h = np.add.reduceat(letters, starts) * self.inverse[starts]  # the value of each word's polynomial
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29)), np.searchsorted(text_of[first], np.arange(len(texts) + 1))


def grams(tokens: np.ndarray, kind: str) -> list[np.ndarray]:
    """Hashes of the n-grams that begin at each place, one array a pattern."""
    out = []
    for k, pattern in enumerate(PATTERNS if kind == "w" else [tuple(range(CHARS))]):
        n = len(tokens) - pattern[-1]
        if n <= 0:
            out.append(np.zeros(0, np.uint64))
            continue
        row = k if kind == "w" else len(PATTERNS)
        h = tokens[:n] * _MUL[row, 0]
        for q, o in enumerate(pattern[1:], 1):
            h = h + tokens[o : o + n] * _MUL[row, q]
        out.append(h ^ (h >> np.uint64(30)))
    return out


def hits_of(texts: list[str], folder: Folder, wanted: np.ndarray | None, kinds: str, table: np.ndarray | None) -> list[np.ndarray]:
    """For each text the distinct n-grams that are ``wanted`` (sorted; None: all of them)."""
    rows, found = [], []
    for kind in kinds:
        at = np.arange(len(texts)) if kind == "w" else np.array([i for i, t in enumerate(texts) if not t.isascii()], np.int64)
        if not len(at):
            continue
        tokens, start = folder.tokens([texts[i] for i in at], kind)
        text_of = np.repeat(np.arange(len(at)), np.diff(start))
        for pattern, h in zip(PATTERNS if kind == "w" else [(CHARS - 1,)], grams(tokens, kind)):
            n = len(h)
            good = text_of[:n] == text_of[pattern[-1] : pattern[-1] + n]
            if wanted is not None:
                good &= table[(h >> np.uint64(42)).astype(np.int64)]
                places = np.flatnonzero(good)
                x = np.minimum(np.searchsorted(wanted, h[places]), max(len(wanted) - 1, 0))
                places = places[wanted[x] == h[places]] if len(wanted) else places[:0]
            else:
                places = np.flatnonzero(good)
            rows.append(at[text_of[places]])
            found.append(h[places])
    if not rows:
        return [np.zeros(0, np.uint64)] * len(texts)
    t, h = np.concatenate(rows), np.concatenate(found)
    _, once = np.unique(h + t.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), return_index=True)
    once = once[np.argsort(t[once], kind="stable")]
    t, h = t[once], h[once]
    cuts = np.searchsorted(t, np.arange(len(texts) + 1))
    return [h[a:b] for a, b in zip(cuts, cuts[1:])]


def align_bands(items: list[np.ndarray], docs: list[np.ndarray], diagonals: np.ndarray) -> list[list[tuple[int, int]]]:
    """Matched places (i, j) of each item and document within ``HALF`` of a diagonal j - i, by Smith-Waterman with repeated
    matches: alignments that score more than THRESHOLD follow each other along the item. All bands advance a row at a time."""
    n, width = len(items), 2 * HALF + 1
    rows = max(map(len, items))
    a = np.zeros((n, rows), np.uint64)
    b = np.full((n, rows + width), 1, np.uint64)  # the part of the document that the band can reach; 1 and 0 stand for no token
    for k, (x, y, d) in enumerate(zip(items, docs, diagonals.tolist())):
        a[k, : len(x)] = x
        lo, hi = max(d - HALF, 0), min(d - HALF + rows + width, len(y))
        if hi > lo:
            b[k, lo - d + HALF : hi - d + HALF] = y[lo:hi]
    far = np.int32(-(1 << 28))
    ramp = np.arange(width, dtype=np.int32) * GAP
    h = np.zeros((n, width), np.int32)
    rest = np.zeros(n, np.int32)  # best total of alignments that have ended
    step = np.zeros((rows + 1, n, width), np.uint8)  # 0 begins here, 1 diagonal, 2 item only, 3 document only
    ended = np.full((rows + 1, n), -1, np.int16)  # place in the band of the row before where an alignment ended, or -1
    windows = np.lib.stride_tricks.sliding_window_view(b, width, axis=1)
    for i in range(1, rows + 1):
        top = h.argmax(axis=1)
        close = h[np.arange(n), top] - THRESHOLD
        stop = close > rest
        ended[i, stop] = top[stop]
        rest = np.where(stop, close, rest)
        diagonal = h + np.where(windows[:, i - 1] == a[:, i - 1, None], MATCH, MISMATCH).astype(np.int32)
        up = np.full((n, width), far)
        up[:, :-1] = h[:, 1:] + GAP
        best = np.maximum(diagonal, up)
        kind = np.where(diagonal >= up, 1, 2).astype(np.uint8)
        begin = best <= rest[:, None]
        best = np.where(begin, rest[:, None], best)
        kind[begin] = 0
        along = np.maximum.accumulate(best - ramp, axis=1) + ramp
        kind[along > best] = 3
        h, step[i] = along, kind
    top = h.argmax(axis=1)
    ends = h[np.arange(n), top] - THRESHOLD > rest
    place = np.where(ends, top, -1)  # -1: between alignments
    row = np.full(n, rows)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    every = np.arange(n)
    while (live := row > 0).any():
        inside = live & (place >= 0)
        between = live & (place < 0)
        kind = np.full(n, 9, np.uint8)
        kind[inside] = step[row[inside], every[inside], place[inside]]
        for k in np.flatnonzero(kind == 1):
            i = int(row[k])
            j = i - 1 + int(place[k])  # in the reachable part
            if a[k, i - 1] == b[k, j]:
                paths[k].append((i - 1, j + int(diagonals[k]) - HALF))
        came = np.full(n, -1)
        came[between] = ended[row[between], every[between]]
        place = np.where(kind == 0, -1, np.where(kind == 2, place + 1, np.where(kind == 3, place - 1, place)))
        place[between] = came[between]
        row = row - ((kind == 1) | (kind == 2) | between)
    return [p[::-1] for p in paths]


def covered(path: list[tuple[int, int]], kind: str, mark: np.ndarray) -> None:
    """Marks the item's places in stretches of a path of matched places."""
    runs: list[list[int]] = []
    for i, j in path:
        if runs and i == runs[-1][1] + 1 and j == runs[-1][3] + 1:
            runs[-1][1], runs[-1][3] = i, j
        else:
            runs.append([i, i, j, j])
    least, cost, jump = LEAST[kind], COST[kind], JUMP[kind]
    at = 0
    while at < len(runs):
        # the best-scoring chain that begins at this run: ends where the score drops to nothing or the gap is no single change
        score = best = runs[at][1] - runs[at][0] + 1
        end = k = at
        while k + 1 < len(runs) and runs[k + 1][0] - runs[k][1] - 1 <= jump and runs[k + 1][2] - runs[k][3] - 1 <= jump and score > cost:
            k += 1
            score += runs[k][1] - runs[k][0] + 1 - cost
            if score > best:
                best, end = score, k
        if sum(r[1] - r[0] + 1 for r in runs[at : end + 1]) >= least:
            mark[runs[at][0] : runs[end][1] + 1] = True
        at = end + 1


class Item:
    """An item's tokens and its n-grams, sorted, with their places."""

    def __init__(self, folder: Folder, lang: str | None, text: str | None):
        self.kind = kind_of(lang)
        self.tokens = folder.tokens([passage(text or "")], self.kind)[0]
        by = grams(self.tokens, self.kind)
        h, at = np.concatenate(by), np.concatenate([np.arange(len(x)) for x in by])
        order = np.argsort(h, kind="stable")
        self.grams, self.places, self.pattern = h[order], at[order], np.repeat(np.arange(len(by)), [len(x) for x in by])[order]
        self.offsets = PATTERNS if self.kind == "w" else (tuple(range(CHARS)),)


def bands_of(item: Item, own: tuple[np.ndarray, np.ndarray]) -> list[int]:
    """Diagonals of the bands of a document that could hold a stretch; ``own``: its n-grams and their places."""
    h, places = own
    lo = np.minimum(np.searchsorted(item.grams, h, "left"), len(item.grams) - 1)
    met = np.flatnonzero(item.grams[lo] == h)
    if not len(met):
        return []
    lo, hi = lo[met], np.searchsorted(item.grams, h[met], "right")
    n = hi - lo
    which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
    at = item.places[which]
    diagonal = np.repeat(places[met], n) - at
    hits = sorted(zip(diagonal.tolist(), at.tolist(), item.pattern[which].tolist()))
    out, k, offsets = [], 0, item.offsets
    while k < len(hits):
        first, end = hits[k][0], k
        places = set()
        while end < len(hits) and hits[end][0] <= first + 2 * HALF - 4:
            places.update([hits[end][1] + o for o in offsets[hits[end][2]]])
            end += 1
        if len(places) >= SPREAD[item.kind]:
            out.append((first + hits[end - 1][0]) // 2)
        k = end
    return out


def _holds(tokens: np.ndarray, part: np.ndarray) -> bool:
    """Whether ``part`` stands in ``tokens`` as it is: then alignment has nothing to add."""
    whole, sought, at = tokens.tobytes(), part.tobytes(), -1
    while (at := whole.find(sought, at + 1)) >= 0:
        if at % 8 == 0:
            return True
    return False


def coverages(pairs: list[tuple[str, Item]], folder: Folder, most: int = 1024) -> np.ndarray:
    """Share of the item that stands in the text, for each pair."""
    marks = [np.zeros(len(item.tokens), bool) for _, item in pairs]
    for kind in ("w", "c"):
        mine = [k for k, (_, item) in enumerate(pairs) if item.kind == kind and len(item.tokens) >= LEAST[kind]]
        texts = list(dict.fromkeys(pairs[k][0] for k in mine))
        if not texts:
            continue
        tokens, start = folder.tokens(texts, kind)
        doc = {t: tokens[start[x] : start[x + 1]] for x, t in enumerate(texts)}
        own: dict[str, tuple] = {}
        work: list[tuple[int, int]] = []
        for k in mine:
            text, item = pairs[k]
            if _holds(doc[text], item.tokens):
                marks[k][:] = True
                continue
            if text not in own:
                by = grams(doc[text], kind)
                own = {text: (np.concatenate(by), np.concatenate([np.arange(len(x)) for x in by]))}
            work += [(k, d) for d in bands_of(item, own[text])]
        for lo in range(0, len(work), most):
            part = work[lo : lo + most]
            paths = align_bands([pairs[k][1].tokens for k, _ in part], [doc[pairs[k][0]] for k, _ in part], np.array([d for _, d in part]))
            for (k, _), path in zip(part, paths):
                covered(path, kind, marks[k])
    return np.array([m.mean() if len(m) else 0.0 for m in marks])


def item_grams(items: DataFrame) -> DataFrame:
    """(item_id, pattern, place, gram) of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for item, lang, text in zip(*(b.column(i).to_pylist() for i in range(3))):
                kind = kind_of(lang)
                tokens = folder.tokens([passage(text or "")], kind)[0]
                if len(tokens) < LEAST[kind]:
                    continue
                for p, h in enumerate(grams(tokens, kind)):
                    cols[0] += [item] * len(h)
                    cols[1] += [p if kind == "w" else -1] * len(h)
                    cols[2] += range(len(h))
                    cols[3] += h.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names=["item_id", "pattern", "place", "gram"])

    return items.mapInArrow(run, "item_id long, pattern int, place int, gram long")


def rare_seeds(known: DataFrame, counts: DataFrame) -> DataFrame:
    """(gram, item_id): of each two neighbouring n-grams of an item the one in fewer documents; ``counts``: gram, n."""
    own = known.join(counts, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("item_id", "pattern").orderBy("place")
    own = own.withColumn("after", F.lead("n").over(w)).withColumn("before", F.lag("n").over(w))
    rarer = (F.col("n") <= F.col("after")) | (F.col("n") < F.col("before")) | (F.col("after").isNull() & F.col("before").isNull())
    return own.where(rarer).select("gram", "item_id").distinct()


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = 1 / 3, filter_bytes: int = 256 << 20) -> DataFrame:
    """(id, item_id, coverage) of each document and item with at least ``least_share`` of the item's passage in the document. ``items``: item_id, lang, text."""
    spark = docs.sparkSession
    id_kind = docs.schema[id_col].dataType.simpleString()
    own = docs.where(F.length(F.col(f"`{text_col}`")) > 0).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    few = written(items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "lang", F.col("text").alias("item_text")), "items")
    n_items, item_bytes = few.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("item_text")), F.lit(0))).first()
    known = written(item_grams(few), "item-grams")
    distinct = known.select("gram").distinct()
    n_grams = known.count()
    kinds = "".join(sorted({"c" if r["pattern"] < 0 else "w" for r in known.select("pattern").distinct().collect()}, reverse=True))  # at most four rows
    shared = None
    if 8 * n_grams <= filter_bytes:
        shared = spark.sparkContext.broadcast(np.sort(np.array([r["gram"] for r in distinct.toLocalIterator()], np.int64).view(np.uint64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = Folder()
        wanted = table = None
        if shared is not None:
            wanted = shared.value
            table = np.zeros(1 << 22, bool)
            table[(wanted >> np.uint64(42)).astype(np.int64)] = True
        for b in batches:
            texts = b.column(1).to_pylist()
            cut = 0
            while cut < len(texts):  # about two million characters at a time
                end, size = cut, 0
                while end < len(texts) and (end == cut or size + len(texts[end]) <= 2_000_000):
                    size += len(texts[end])
                    end += 1
                found = hits_of(texts[cut:end], folder, wanted, kinds, table)
                keep = [i for i, h in enumerate(found) if len(h)]
                rows = pa.array([cut + i for i in keep], pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(found[i]) for i in keep)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.uint64), *(found[i] for i in keep)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), lists], names=["id", "text", "grams"])
                cut = end

    hit = written(own.mapInArrow(scan, f"id {id_kind}, text string, grams array<long>"), "hits")
    said = hit.select("id", F.explode("grams").alias("gram"))
    seeds = written(rare_seeds(known, said.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))), "seeds")
    met = written(said.join(maybe_broadcast(seeds, seeds.count() * 16 <= BROADCAST_LIMIT), "gram").select("id", "item_id").distinct(), "met")
    pairs = hit.select("id", "text").join(maybe_broadcast(met, met.count() * 24 <= BROADCAST_LIMIT), "id")
    pairs = pairs.join(maybe_broadcast(few, item_bytes + 100 * n_items <= BROADCAST_LIMIT), "item_id").select("id", "text", "item_id", "lang", "item_text")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, held = Folder(), {}
        for b in batches:
            texts, ids, langs, passages = (b.column(i).to_pylist() for i in range(1, 5))
            for i, lang, text in zip(ids, langs, passages):
                if i not in held:
                    held[i] = Item(folder, lang, text)
            share = coverages([(t, held[i]) for t, i in zip(texts, ids)], folder)
            rows = pa.array(np.flatnonzero(share >= least_share), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), pa.array(share).take(rows)], names=["id", "item_id", "coverage"])
            if len(held) > 100_000:
                held = {}

    found = pairs.mapInArrow(align, f"id {id_kind}, item_id long, coverage double")
    return found.groupBy(F.col("id").alias(id_col), "item_id").agg(F.max("coverage").alias("coverage"))
