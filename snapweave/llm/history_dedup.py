"""New batches against everything accepted so far, at a cost that follows the batch.

The history is a set of sorted runs (see keyed_runs), three kinds of them for each batch appended:

* ``ids``   - ids known so far, with the accepted id that a refused record repeats;
* ``keys``  - minwise band keys of accepted records, each with the record's number and its signature of 64 bits;
* ``texts`` - id and words of accepted records, by a hash of their number.

A batch looks up its own ids and band keys, reading only the blocks that can hold them; a found key whose signature is too
far away is left out there; the words of the others are read by number and compared. Nothing else of the history is read,
shuffled or listed. Runs are merged when ``FANOUT`` of one size have gathered, so there are few however many batches came.

A batch is decided in this order: repeated ids (known ones, then later ones within the batch); equal contents within the
batch, which share the fate of the first; near-duplicates of accepted records; near-duplicates within the batch. The rule
is the same everywhere: a record that is similar to accepted records repeats the *earliest* of those it shares a band with,
so decisions do not depend on how records are grouped into batches.

Large groups are never paired out. Of each band a record is first compared with the few earliest accepted records only; that
settles the copies of a large group, whose earliest member is among them. Only a record that these leave open (no similar
one found, or an earlier one possible) meets the next ones, sixteen times as many in each round. Within a batch the same
is done in waves: the first ``heads`` undecided or accepted members of each band are compared with the others; a record is
accepted when all before it in its bands were compared and none is similar, and is a repeat when the earliest similar one
is accepted. Waves end: the earliest undecided record is decided as soon as the heads reach it.

Similar means: the longest common subsequence of words is at least nine tenths of the longer text; case, punctuation and
layout do not count. The bands are over single words with their repetition number, not over longer shingles: one changed
word in ten leaves half of the five-word shingles, but nine tenths in common leave a Jaccard similarity of single words of
at least 0.9 / 1.1, which 16 bands of 4 miss once in 13,000. Signatures hold one bit of each of the 64 minima; at that
similarity 5.8 of them differ on average and more than ``FAR`` = 18 about once in a million.

Records with null or wordless content are compared by id only, with a null id by content only. Rows that stand several
times under one (batch, record) count once, the least by id and content. Ids are compared by 128 bits of hash.
Empty batches change nothing. Further columns are ignored.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapweave.llm.keyed_runs import Runs, bits_for, read_run, write_runs
from snapweave.operators.compaction import _files
from snapweave.session import BROADCAST_LIMIT, Scratch, delete_path, maybe_broadcast, new_path, pieces

BANDS, ROWS, FAR, FANOUT = 16, 4, 18, 8
_WORD = re.compile(r"[^\W_]+")
_SCHEMA = "rec_id long, ord long, id binary, words string, content_key binary, bands array<long>, sig long"
IDS, KEYS, TEXTS = 0, 1, 2


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.casefold()) if text else []


class Signer:
    """Minwise band keys of word lists, and one bit of each minimum."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.mul = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) | np.uint64(1)
        self.add = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        self.mix = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)

    def keys(self, words: list[str]) -> list[int]:
        return self.keys_and_bits(words)[0]

    def keys_and_bits(self, words: list[str]) -> tuple[list[int], int]:
        import xxhash

        seen: Counter = Counter()
        hashes = []
        for w in words:
            n = seen[w]
            seen[w] += 1
            hashes.append(xxhash.xxh64_intdigest(w, seed=n))
        x = np.array(hashes, np.uint64)[:, None] * self.mul[None, :] + self.add[None, :]
        x ^= x >> np.uint64(29)
        least = x.min(axis=0)
        bits = int(np.packbits((least & np.uint64(1)).astype(np.uint8)).view(np.int64)[0]) if len(least) == 64 else 0
        low = least.reshape(self.bands, self.rows) * self.mix[None, :]
        low ^= low >> np.uint64(31)
        key = low.sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(self.bands, dtype=np.uint64)
        return key.view(np.int64).tolist(), bits


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one bit per word of ``a``."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        u = v & at.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def similar(a: list[str], b: list[str], tenths: int = 9) -> bool:
    """Whether at least tenths/10 of the longer list stand in both, in order."""
    longer = max(len(a), len(b))
    if not a or not b or 10 * min(len(a), len(b)) < tenths * longer:
        return False
    if a == b:
        return True
    if 10 * sum((Counter(a) & Counter(b)).values()) < tenths * longer:
        return False
    return 10 * common_words(a, b) >= tenths * longer


def sign(records: DataFrame, rec_col: str, batch_col: str, id_key: Column, text_col: str, extra: list[str] = []) -> DataFrame:
    """The columns of _SCHEMA and ``extra`` for each row; ord puts records in order of (batch, record)."""
    import hashlib

    order = F.shiftleft(F.col(f"`{batch_col}`").cast("long"), 48) + F.col(f"`{rec_col}`")
    own = records.select(F.col(f"`{rec_col}`").cast("long").alias("rec_id"), order.alias("ord"), id_key.alias("id"), F.col(f"`{text_col}`").alias("text"), *[F.col(c) for c in extra])
    kinds = "".join(f", `{c}` {own.schema[c].dataType.simpleString()}" for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer()
        for b in batches:
            texts, digests, bands, sigs = [], [], [], []
            for t in b.column(3).to_pylist():
                w = words_of(t)
                texts.append(" ".join(w))
                digests.append(hashlib.sha256(texts[-1].encode()).digest() if w else None)
                keys, bits = signer.keys_and_bits(w) if w else ([], 0)
                bands.append(keys)
                sigs.append(bits)
            made = [b.column(0), b.column(1), b.column(2), pa.array(texts), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.int64())]
            yield pa.RecordBatch.from_arrays([*made, *[b.column(4 + i) for i in range(len(extra))]], names=["rec_id", "ord", "id", "words", "content_key", "bands", "sig", *extra])

    return own.mapInArrow(run, _SCHEMA + kinds)


def _verified(pairs: DataFrame) -> DataFrame:
    """(ord, other, similar) of pairs (ord, other, words, other_words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [similar(x.split(" "), y.split(" ")) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(same, pa.bool_())], names=["ord", "other", "similar"])

    return pairs.select("ord", "other", "words", "other_words").mapInArrow(run, "ord long, other long, similar boolean")


def _close(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= FAR


def _small(n: int, row_bytes: int) -> bool:
    return n * row_bytes <= BROADCAST_LIMIT


class History:
    """What has been accepted, in a folder that executors share; a folder with a history in it is opened as it stands."""

    def __init__(self, spark: SparkSession, root: str | None = None, heads: int = 4):
        self.spark, self.root, self.heads = spark, root or new_path(spark, "history"), heads
        self.fs, self.path = _files(self.root)
        #: per kind: folder, bits, rows of each run
        self.runs: dict[int, list[list]] = {IDS: [], KEYS: [], TEXTS: []}
        try:
            with self.fs.open_input_stream(f"{self.path}/manifest.json") as f:
                self.runs = {int(k): v for k, v in json.loads(f.read()).items()}
        except FileNotFoundError:
            self.fs.create_dir(self.path, recursive=True)
        #: rows and files that lookups read so far, for reports
        self.rows_read, self.files_read = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def _of(self, kind: int) -> list[tuple[str, int]]:
        return [(folder, bits) for folder, bits, _ in self.runs[kind]]

    def _save(self) -> None:
        """The manifest is put in place last: a batch is in the history whole or not at all."""
        with self.fs.open_output_stream(f"{self.path}/manifest.tmp") as f:
            f.write(json.dumps(self.runs).encode())
        self.fs.move(f"{self.path}/manifest.tmp", f"{self.path}/manifest.json")

    def _append(self, rows: DataFrame, counts: dict[int, int]) -> None:
        targets = {}
        for kind, n in counts.items():
            if n:
                targets[kind] = (f"{self.root}/{kind}-{uuid.uuid4().hex}", bits_for(n))
        if not targets:
            return
        write_runs(rows, targets, sum(counts.values()))
        for kind, (folder, bits) in targets.items():
            self.runs[kind].append([folder, bits, counts[kind]])
        old = self._merge()
        self._save()
        for folder in old:
            delete_path(self.spark, folder)

    def _merge(self) -> list[str]:
        """Merges runs of one size class (a factor of FANOUT in rows) when FANOUT of them are there; the folders no longer needed."""
        gone: list[str] = []
        for kind, runs in self.runs.items():
            classes: dict[int, list] = {}
            for r in runs:
                classes.setdefault((r[2].bit_length() - 1) // (FANOUT.bit_length() - 1), []).append(r)
            for same in classes.values():
                if len(same) >= FANOUT:
                    n = sum(r[2] for r in same)
                    folder, bits = f"{self.root}/{kind}-{uuid.uuid4().hex}", bits_for(n)
                    write_runs(read_run(self.spark, [(r[0], r[1]) for r in same], kind), {kind: (folder, bits)}, n)
                    self.runs[kind] = [r for r in self.runs[kind] if r not in same] + [[folder, bits, n]]
                    gone += [r[0] for r in same]
        return gone

    def know_ids(self, ids: DataFrame) -> None:
        """Adds ids (column ``id``) that count as accepted without a record."""
        own = ids.where("id is not null")
        self._append(_id_rows(own.select("id", F.lit(None).cast("binary").alias("kept"))), {IDS: own.count()})

    def _lookup(self, asks: DataFrame, kind: int, n_asks: int, run, schema: str, by: list[str]) -> DataFrame:
        """``asks`` in ranges of ``by`` (the key first), through ``run(runs, batches)``."""
        runs, rows, files = self._of(kind), self.rows_read, self.files_read
        n = pieces(n_asks, 200_000, least=min(self.spark.sparkContext.defaultParallelism, pieces(n_asks, 5_000)))

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = Runs(runs)
            yield from run(held, batches)
            held.close()
            rows.add(held.rows)
            files.add(held.files)

        return asks.repartitionByRange(n, *by).sortWithinPartitions(by[0]).mapInArrow(task, schema)

    def _known(self, firsts: DataFrame, n: int) -> DataFrame:
        """``firsts`` (id, first, n) that are known, or stand several times: adds known and kept."""

        def run(held: Runs, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h1, h2 = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
                keys, inverse = np.unique(h1, return_inverse=True)
                found: dict[tuple, bytes | None] = {}
                for places, rec, f in held.find(keys):
                    for p, a, at in zip(places.tolist(), rec["a"].tolist(), rec["b"].tolist()):
                        if (p, a) not in found:
                            found[p, a] = f.payload(at)
                asked = list(zip(inverse.tolist(), h2.tolist()))
                known = [x in found for x in asked]
                keep = pa.array([k or m > 1 for k, m in zip(known, b.column(4).to_pylist())], pa.bool_())
                out = pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(known, pa.bool_()), pa.array([found.get(x) for x in asked], pa.binary())], names=["id", "first", "known", "kept"])
                yield out.filter(keep)

        asks = firsts.select(F.xxhash64("id").alias("h1"), F.xxhash64(F.lit(7), "id").alias("h2"), "id", "first", "n")
        return self._lookup(asks, IDS, n, run, "id binary, first long, known boolean, kept binary", ["h1"])

    def _hits(self, asks: DataFrame, n_asks: int, most: int) -> DataFrame:
        """(ord, other, reach): for each asked (band, ord, sig, below) the ``most`` earliest accepted records of the band with a close
        signature and a number less than ``below``; reach is the last of them if there are more, else null."""

        def run(held: Runs, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                band, order, sig, below = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(), b.column(2).to_numpy().view(np.uint64), b.column(3).to_numpy()
                keys, inverse = np.unique(band, return_inverse=True)
                rows_of = np.argsort(inverse, kind="stable")
                start = np.searchsorted(inverse[rows_of], np.arange(len(keys) + 1))
                got: dict[int, list[int]] = {}  # row of the batch -> numbers, the least `most` + 1
                for places, rec, _ in held.find(keys):
                    cuts = [0, *(np.flatnonzero(np.diff(places)) + 1), len(places)]
                    for lo, hi in zip(cuts, cuts[1:]):
                        mine, r = rows_of[start[places[lo]] : start[places[lo] + 1]], rec[lo:hi]
                        for at in range(0, len(mine), 4096):
                            own = mine[at : at + 4096]
                            near = (np.bitwise_count(sig[own][:, None] ^ r["b"].view(np.uint64)[None, :]) <= FAR) & (r["a"][None, :] < below[own][:, None])
                            for i in np.flatnonzero(near.any(axis=1)):
                                x = got.setdefault(int(own[i]), [])
                                x += r["a"][near[i]][: most + 1].tolist()
                                if len(x) > most + 1:
                                    x.sort()
                                    del x[most + 1 :]
                ids, others, reach = [], [], []
                for i, x in got.items():
                    x.sort()
                    more = len(x) > most
                    ids += [int(order[i])] * len(x[:most])
                    others += x[:most]
                    reach += [x[most - 1] if more else None] * len(x[:most])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(reach, pa.int64())], names=["ord", "other", "reach"])

        return self._lookup(asks.select("band", "ord", "sig", "below"), KEYS, n_asks, run, "ord long, other long, reach long", ["band", "ord"])

    def _compared(self, pairs: DataFrame, n_pairs: int) -> DataFrame:
        """(ord, other, other_id, similar) of (ord, other, words); the other's words come from the history."""

        def run(held: Runs, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = b.column(0).to_numpy().view(np.uint64)
                other, words = b.column(2).to_pylist(), b.column(3).to_pylist()
                keys, inverse = np.unique(h, return_inverse=True)
                text: dict[tuple, bytes] = {}
                for places, rec, f in held.find(keys):
                    for p, a, at in zip(places.tolist(), rec["a"].tolist(), rec["b"].tolist()):
                        text[p, a] = f.payload(at)
                ids, same = [], []
                split: dict[tuple, list[str]] = {}
                for p, o, w in zip(inverse.tolist(), other, words):
                    data = text[p, o]
                    n = int.from_bytes(data[:4], "little", signed=True)
                    ids.append(data[4 : 4 + n] if n >= 0 else None)
                    if (p, o) not in split:
                        split[p, o] = data[4 + max(n, 0) :].decode().split(" ")
                    same.append(similar(w.split(" "), split[p, o]))
                yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array(ids, pa.binary()), pa.array(same, pa.bool_())], names=["ord", "other", "other_id", "similar"])

        asks = pairs.select(F.xxhash64("other").alias("h"), "ord", "other", "words")
        return self._lookup(asks, TEXTS, n_pairs, run, "ord long, other long, other_id binary, similar boolean", ["h", "ord"])

    def _against_history(self, batch: DataFrame, alone: DataFrame, n_asks: int, tmp: Scratch) -> DataFrame | None:
        """(ord, other, other_id): the earliest similar accepted record of each record in ``alone`` that has one."""
        if not self.runs[KEYS]:
            return None
        limit = (1 << 63) - 1
        asks = batch.select("ord", "sig", F.explode("bands").alias("band"), F.lit(limit).alias("below"))
        best: DataFrame | None = None
        most = self.heads
        while True:
            hits = tmp.written(self._hits(asks, n_asks, most).groupBy("ord", "other").agg(F.min("reach").alias("reach")), "hits")
            n_hits, n_open = hits.agg(F.count(F.lit(1)), F.count("reach")).first()
            if not n_hits:
                return best
            words = batch.where("content_key is not null").select("ord", "words")
            pairs = alone.select("ord").join(maybe_broadcast(hits.select("ord", "other"), _small(n_hits, 16)), "ord")
            pairs = tmp.written(words.join(maybe_broadcast(pairs, _small(n_hits, 16)), "ord"), "pairs")
            seen = tmp.written(self._compared(pairs, n_hits), "seen")
            least = seen.where("similar").groupBy("ord").agg(F.min(F.struct("other", "other_id")).alias("x")).select("ord", "x.other", "x.other_id")
            best = least if best is None else best.unionByName(least).groupBy("ord").agg(F.min(F.struct("other", "other_id")).alias("x")).select("ord", "x.other", "x.other_id")
            best = tmp.written(best, "best")
            if not n_open:
                return best
            # records that may have an earlier similar one beyond what was compared
            reach = hits.where("reach is not null").groupBy("ord").agg(F.min("reach").alias("reach")).join(alone.select("ord"), "ord", "left_semi")
            open_ = reach.join(best, "ord", "left").where("other is null or other > reach").select("ord", F.coalesce("other", F.lit(limit)).alias("below"))
            open_ = tmp.written(open_, "open")
            left = open_.count()
            if not left:
                return best
            most *= 16
            n_asks = left * BANDS
            asks = batch.select("ord", "sig", F.explode("bands").alias("band")).join(maybe_broadcast(open_, _small(left, 16)), "ord")

    def _within(self, batch: DataFrame, out: DataFrame, n_out: int, tmp: Scratch) -> DataFrame | None:
        """(ord, other): records of the batch, but those in ``out``, that repeat an earlier one of it, which is accepted."""
        own = batch.select("ord", "sig", F.explode("bands").alias("band")).join(maybe_broadcast(out.select("ord"), _small(n_out, 8)), "ord", "left_anti")
        shared = tmp.written(own.select("band", "ord").groupBy("band").agg(F.min("ord").alias("lo"), F.max("ord").alias("hi")).where("lo < hi").select("band"), "shared")
        n_shared = shared.count()
        if not n_shared:
            return None
        members = tmp.written(own.join(maybe_broadcast(shared, _small(n_shared, 8)), "band").dropDuplicates(["band", "ord"]), "members")
        texts = batch.where("content_key is not null").select("ord", "words")
        decided: DataFrame | None = None  # (ord, other): other null for accepted ones
        heads = self.heads
        while True:
            live, asking = members, members
            if decided is not None:
                live = members.join(decided.where("other is not null").select("ord"), "ord", "left_anti")
                asking = members.join(decided.select("ord"), "ord", "left_anti")
            ranked = live.select("band", "ord", "sig").withColumn("r", F.row_number().over(Window.partitionBy("band").orderBy("ord"))).where(F.col("r") <= heads + 1)
            ranked = tmp.written(ranked, "heads")
            met = asking.join(ranked.select("band", F.col("ord").alias("other"), F.col("sig").alias("other_sig"), "r"), "band").where("other < ord")
            # a member beyond the heads only marks how far this wave sees
            met = met.select("ord", "other", F.when(F.col("r") > heads, F.col("other")).alias("reach"), (F.col("r") <= heads) & _close(F.col("sig"), F.col("other_sig")))
            met = met.toDF("ord", "other", "reach", "near").where("near or reach is not null").groupBy("ord", "other").agg(F.min("reach").alias("reach"), F.max("near").alias("near"))
            met = tmp.written(met, "met")
            n_near = met.where("near").count()
            near = met.where("near").select("ord", "other")
            pairs = texts.join(maybe_broadcast(near, _small(n_near, 16)), "ord")
            pairs = pairs.join(texts.select(F.col("ord").alias("other"), F.col("words").alias("other_words")), "other")
            same = _verified(pairs).where("similar").select("ord", "other")
            if decided is not None:  # repeats refused earlier no longer count
                same = same.join(decided.where("other is not null").select(F.col("ord").alias("other")), "other", "left_anti")
            reach = met.groupBy("ord").agg(F.min("reach").alias("reach"))
            first = same.groupBy("ord").agg(F.min("other").alias("first"))
            state = asking.select("ord").distinct().join(reach, "ord", "left").join(first, "ord", "left")
            state = tmp.written(state, "state")
            fine = state.where("reach is null and first is null").select("ord", F.lit(None).cast("long").alias("other"))
            accepted = fine if decided is None else fine.unionByName(decided.where("other is null"))
            seen = state.where("first is not null and (reach is null or first < reach)").select("ord", "first")
            repeats = seen.join(accepted.select(F.col("ord").alias("first")), "first").select("ord", F.col("first").alias("other"))
            now = fine.unionByName(repeats)
            decided = tmp.written(now if decided is None else decided.unionByName(now), "decided")
            if state.select("ord").join(decided.select("ord"), "ord", "left_anti").isEmpty():
                return decided.where("other is not null")
            heads *= 16

    def _decide(self, batch: DataFrame, tmp: Scratch, compare: bool) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        """(rec_id, ord, id, content_key, kept, reason) of a batch; ``compare`` false accepts all of it. With it: the batch without
        rows that do not count, the copies (ord) in it, and its number of records."""
        row = F.struct("id", "content_key", "rec_id")
        one = batch.groupBy("ord").agg(F.min(row).alias("x"), (F.min(row) != F.max(row)).alias("odd")).select("ord", "x.*", "odd")
        one = tmp.written(one, "records")
        n, n_odd = one.agg(F.count(F.lit(1)), F.count_if("odd")).first()
        if n_odd:  # different rows under one number
            batch = batch.join(one.select("ord", F.col("content_key").alias("one_key")), "ord").where(F.col("content_key").eqNullSafe(F.col("one_key"))).drop("one_key")
        firsts = one.where("id is not null").groupBy("id").agg(F.min("ord").alias("first"), F.count(F.lit(1)).alias("n"))
        if compare:
            met = tmp.written(self._known(firsts, n), "met")
            n_met = met.count()
            state = one.join(maybe_broadcast(met, _small(n_met, 100)), "id", "left")
            state = state.withColumn("by_id", F.coalesce(F.col("known") | (F.col("first") < F.col("ord")), F.lit(False)))
        else:
            state = one.withColumn("known", F.lit(False)).withColumn("kept", F.lit(None).cast("binary")).withColumn("by_id", F.lit(False))
        state = tmp.written(state.select("rec_id", "ord", "id", "content_key", "known", "kept", "by_id"), "state")
        fresh = state.where("not by_id and content_key is not null")
        leaders = fresh.groupBy("content_key").agg(F.min("ord").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("content_key", "leader")
        leaders = tmp.written(leaders, "leaders")
        n_leaders = leaders.count()
        copies = fresh.join(maybe_broadcast(leaders, _small(n_leaders, 50)), "content_key").where("leader < ord").select("ord", "leader")
        copies = tmp.written(copies, "copies")
        n_copies = copies.count()
        if not compare:
            return state.select("rec_id", "ord", "id", "content_key", "kept", F.lit(None).cast("string").alias("reason")), batch, copies, n
        alone = fresh.join(maybe_broadcast(copies.select("ord"), _small(n_copies, 8)), "ord", "left_anti")
        old = self._against_history(batch, alone, n * BANDS, tmp)
        out = state.where("by_id or content_key is null").select("ord").unionByName(copies.select("ord"))
        if old is not None:
            out = out.unionByName(old.select("ord"))
        out = tmp.written(out, "out")
        new = self._within(batch, out, out.count(), tmp)
        found = one.select("ord").limit(0).select("ord", F.lit(None).cast("binary").alias("other_id"), F.lit("").alias("how"))
        if old is not None:
            found = found.unionByName(old.select("ord", "other_id", F.lit("history").alias("how")))
        if new is not None:
            named = new.join(one.select(F.col("ord").alias("other"), F.col("id").alias("other_id")), "other")
            found = found.unionByName(named.select("ord", "other_id", F.lit("batch").alias("how")))
        found = tmp.written(found, "found")
        n_found = found.count()
        near = maybe_broadcast(found, _small(n_found, 60))
        # copies share the fate of the first of them
        led = copies.join(near.withColumnRenamed("ord", "leader"), "leader", "left").join(one.select(F.col("ord").alias("leader"), F.col("id").alias("leader_id")), "leader")
        led = led.select("ord", F.when(F.col("how").isNotNull(), F.col("other_id")).otherwise(F.col("leader_id")).alias("other_id"), F.coalesce("how", F.lit("copy")).alias("how"))
        both = tmp.written(found.unionByName(led), "both")
        n_both = both.count()
        decided = state.join(maybe_broadcast(both, _small(n_both, 60)), "ord", "left")
        decided = decided.select(
            "rec_id", "ord", "id", "content_key", F.when(F.col("by_id"), F.coalesce("kept", "id")).otherwise(F.col("other_id")).alias("kept"),
            F.when(F.col("by_id"), "id").otherwise(F.col("how")).alias("reason"), (F.col("by_id") & ~F.coalesce("known", F.lit(False))).alias("inner"),
        )
        # an id that repeats a record of this very batch leads on to what that one repeats
        further = decided.where("reason is not null and reason <> 'id' and id is not null").groupBy("id").agg(F.min(F.struct("ord", "kept")).alias("y")).select("id", F.col("y.kept").alias("further"))
        decided = decided.join(maybe_broadcast(further, _small(n_both, 100)), "id", "left")
        decided = decided.withColumn("kept", F.when(F.col("inner"), F.coalesce("further", "kept")).otherwise(F.col("kept")))
        return decided.select("rec_id", "ord", "id", "content_key", "kept", "reason"), batch, copies, n

    def _accept(self, batch: DataFrame, decided: DataFrame, copies: DataFrame, n: int, tmp: Scratch) -> None:
        """Appends the ids of all records of a decided batch, and keys and texts of the accepted ones, of equal contents the first."""
        ids = decided.where("id is not null and (reason is null or reason <> 'id')").select("id", F.when(F.col("reason").isNotNull(), F.col("kept")).alias("kept"), "ord")
        ids = ids.groupBy("id").agg(F.min(F.struct("ord", "kept")).alias("x")).select("id", "x.kept")
        out = tmp.written(decided.where("reason is not null or content_key is null").select("ord").unionByName(copies.select("ord")).distinct(), "refused")
        n_out = out.count()
        n_in = max(n - n_out, 0)
        chosen = batch.where("content_key is not null").join(maybe_broadcast(out, _small(n_out, 8)), "ord", "left_anti")
        none = F.lit(None).cast("binary")
        keys = chosen.select("ord", "sig", F.explode("bands").alias("band")).select(F.lit(KEYS).alias("kind"), F.col("band").alias("key"), F.col("ord").alias("a"), F.col("sig").alias("b"), none.alias("payload"))
        head = F.unhex(_little(F.coalesce(F.octet_length("id"), F.lit(-1))))
        text = F.concat(head, F.coalesce("id", F.lit(b"").cast("binary")), F.encode("words", "UTF-8"))
        texts = chosen.select(F.lit(TEXTS).alias("kind"), F.xxhash64("ord").alias("key"), F.col("ord").alias("a"), F.lit(-1).cast("long").alias("b"), text.alias("payload"))
        self._append(_id_rows(ids).unionByName(keys).unionByName(texts), {IDS: n, KEYS: n_in * BANDS, TEXTS: n_in})

    def accept(self, batch: DataFrame) -> None:
        """Accepts a signed batch whole. Of equal contents only the first is kept to compare with."""
        tmp = Scratch(self.spark)
        decided, batch, copies, n = self._decide(batch, tmp, compare=False)
        self._accept(batch, decided, copies, n, tmp)
        tmp.close()

    def add_batch(self, batch: DataFrame) -> DataFrame:
        """Decides a signed batch, appends what is accepted, and returns (rec_id, ord, id, kept, reason): kept is the id of the
        accepted record that is repeated, null for accepted records."""
        tmp = Scratch(self.spark)
        decided, batch, copies, n = self._decide(batch, tmp, compare=True)
        path = new_path(self.spark, "decisions")
        decided.write.option("compression", "zstd").parquet(path)
        decided = self.spark.read.schema(decided.schema).parquet(path)
        self._accept(batch, decided, copies, n, tmp)
        tmp.close()
        return decided.select("rec_id", "ord", "id", "kept", "reason")


def _little(n: Column) -> Column:
    """Eight hex digits of a 32-bit number, the least byte first."""
    h = F.lpad(F.right(F.hex(n.cast("long")), F.lit(8)), 8, "0")
    return F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2))


def _id_rows(ids: DataFrame) -> DataFrame:
    """(id, kept) as rows of a run."""
    return ids.select(F.lit(IDS).alias("kind"), F.xxhash64("id").alias("key"), F.xxhash64(F.lit(7), "id").alias("a"), F.lit(-1).cast("long").alias("b"), F.col("kept").alias("payload"))
