from datetime import datetime

import pytest
from pyspark.sql import functions as F

from snapweave.functions import paths as P
from snapweave.functions import scalars as S


def values(spark, rows, schema, *cols):
    df = spark.createDataFrame(rows, schema).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)])
    return [tuple(r) if len(cols) > 1 else r[0] for r in df.collect()]


def test_sizes(spark):
    rows = [(0,), (1023,), (1024,), (1088,), (1536,), (1 << 20,), (5 << 30,), (3 << 40,), (None,)]
    assert values(spark, rows, "n long", S.format_size(F.col("n"))) == ["0 B", "1023 B", "1.000 KiB", "1.062 KiB", "1.500 KiB", "1.000 MiB", "5.000 GiB", "3.000 TiB", None]
    assert values(spark, [(1,), (2,), (0,)], "n long", S.format_count(F.col("n"), "file", "files")) == ["1 file", "2 files", "0 files"]


def test_durations(spark):
    cases = {0: "0s", 7: "7ms", 1000: "1s", 61_000: "1m 1s", 3_600_000: "1h", 3_605_000: "1h 5s", 86_400_000: "1d", 86_400_000 + 300_000: "1d 0h", 86_400_000 + 5_000: "1d 5s", 93_784_000: "1d 2h", 1_500: "1s"}
    assert values(spark, [(k,) for k in cases] + [(None,)], "n long", S.format_duration(F.col("n"))) == [*cases.values(), None]
    texts = {"1y": 31_536_000, "2w3d": 1_468_800, "5m6s": 306, "": 0, "m": None, "5": None, "5x": None, "1h 2m": None, None: None}
    assert values(spark, [(k,) for k in texts], "t string", S.parse_duration(F.col("t"))) == [*texts.values()]


def test_permissions(spark):
    cases = {0o100644: "-rw-r--r--", 0o040755: "drwxr-xr-x", 0o120777: "lrwxrwxrwx", 0o104755: "-rwsr-xr-x", 0o104644: "-rwSr--r--", 0o102755: "-rwxr-sr-x", 0o041777: "drwxrwxrwt", 0o041776: "drwxrwxrwT", 0o010600: "prw-------", 0o020600: "crw-------", 0o060600: "brw-------", 0o140600: "srw-------", 0: "?---------"}
    assert values(spark, [(k,) for k in cases] + [(None,)], "m int", S.permissions(F.col("m"))) == [*cases.values(), None]


def test_tags_and_numbers(spark):
    assert values(spark, [(" b, a,,b ",), ("",), (None,)], "t string", S.parse_tags(F.col("t"))) == [["a", "b"], [], None]
    assert S.retention_number("all") > 10**18 and S.retention_number("3") == 3
    with pytest.raises(ValueError):
        S.retention_number("0")
    assert values(spark, [(0,), (3,), (64,), (65,)], "n long", S.padded_descriptors(F.col("n")), S.header_bytes(F.col("n"))) == [(0, 0), (64, 2368), (64, 2368), (128, 4736)]


def test_urls(spark):
    cases = {
        "sftp://u:p%40x@Host.Org:2222/a/./b/../c%20d?q=1#frag": ("sftp", "u", "p@x", "host.org", 2222, ["a", "c d"], "q=1", "frag"),
        "SFTP://host/": ("sftp", "", None, "host", None, [], None, None),
        "ssh://[::1]:22/x": ("ssh", "", None, "::1", 22, ["x"], None, None),
        "file:///tmp/x": ("file", "", None, None, None, ["", "tmp", "x"], None, None),
        "mailto:a@b": ("mailto", "", None, None, None, ["a@b"], None, None),
        "sftp://host:99999/x": None,
        "sftp://host:/x": None,
        "sftp://[::1/x": None,
        "no scheme": None,
        "1x://h": None,
        None: None,
    }
    got = values(spark, [(k,) for k in cases], "u string", S.parse_url(F.col("u")))
    assert [None if g is None else tuple(g) for g in got] == [*cases.values()]
    places = {"/a/b": ("local", None, None, None, "/a/b"), "sftp://u@h/p/q": ("sftp", "u", "h", 22, "p/q"), "file:///x": ("local", None, None, None, "/x"), "http://h/x": ("unsupported", None, None, None, None)}
    assert [tuple(g) for g in values(spark, [(k,) for k in places], "u string", S.storage_place(F.col("u")))] == [*places.values()]


def test_show_time(spark):
    assert values(spark, [(datetime(2024, 2, 3, 4, 5, 6),), (datetime(1960, 1, 1),), (None,)], "t timestamp_ntz", S.show_time(F.col("t"))) == ["2024-02-03 04:05:06", None, None]


PATHS = ["/a/b/c", "/x/y/z", "/a/b", "/a/b/c/d", "/ab"]


@pytest.mark.parametrize(
    "include, exclude, kept",
    [
        (None, None, PATHS),
        (None, ["/a"], ["/x/y/z", "/ab"]),
        (["/a"], None, ["/a/b/c", "/a/b", "/a/b/c/d"]),
        (["/a/b/c"], None, ["/a/b/c", "/a/b", "/a/b/c/d"]),
        (["/a"], ["/a/b/c"], ["/a/b"]),
        ([], None, []),
    ],
)
def test_filters(spark, include, exclude, kept):
    df = spark.createDataFrame([(p, "x") for p in [*PATHS, None]], "path string, included string")
    assert [r["path"] for r in P.filter_paths(df, "path", include, exclude).collect()] == kept


def test_path_parts(spark):
    rows = [("/",), ("/a",), ("/a/b.txt",), ("file",), ("é/ü",)]
    assert values(spark, rows, "p string", P.parent_of(F.col("p")), P.name_of(F.col("p"))) == [(None, ""), ("/", "a"), ("/a", "b.txt"), (None, "file"), ("é", "ü")]
    df = spark.createDataFrame([("a.b",), ("a/b",)], "p string")
    assert [r["p"] for r in df.orderBy(P.path_order(F.col("p"))).collect()] == ["a/b", "a.b"]


def test_common_prefix_and_children(spark):
    rows = [("one", "/a/b/c"), ("two", "/a/b/c"), ("two", "/a/b/d"), ("three", "/a/b"), ("three", "/a/b/c"), ("four", "/x"), ("four", "/y"), ("five", None)]
    df = spark.createDataFrame(rows, "g string, p string")
    got = lambda strict: {r["g"]: r["lcp"] for r in P.common_prefix(df, "p", "g", strict).collect()}
    assert got(False) == {"one": "/a/b", "two": "/a/b", "three": "/a/b", "four": ""}
    assert got(True)["one"] == "/a/b/c"
    kids = spark.createDataFrame([("/a/b/c",), ("/a/d",), ("/a/b/c",), (None,)], "p string")
    assert {tuple(r) for r in P.children_counts(kids, "p").collect()} == {("/", 1), ("/a", 2), ("/a/b", 1)}


def test_chunks_are_those_of_the_hash_byte_by_byte():
    import random

    from snapweave.operators import chunking as C

    def slow(data, least, average, most):
        bits = average.bit_length() - 1
        strict, loose = C._mask(bits + C.LEVEL), C._mask(max(1, bits - C.LEVEL))
        ends, start = [], 0
        while len(data) - start > least:
            h, at = 0, start + least
            stop, middle = min(len(data), start + most), min(len(data), start + average)
            while at < stop:
                mask = loose if at >= middle else strict
                h = (h * 2 + C.GEAR[data[at]]) % (1 << 64)
                at += 1
                if h & mask == 0:
                    break
            ends.append(at)
            start = at
        return ends + [len(data)] if start < len(data) or not ends else ends

    rng = random.Random(2)
    for n in (0, 1, 63, 64, 65, 300, 5000, 40_000):
        for kind in (256, 3, 1):
            data = bytes(rng.randrange(kind) for _ in range(n))
            for sizes in ((64, 256, 1024), (1, 2, 4), (16, 5000, 9000)):
                assert C.cut_points(data, *sizes) == slow(data, *sizes)


def test_positions_in_a_whole_order(spark):
    from pyspark.sql import functions as F

    from snapweave.operators.packing import ordered_positions

    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("a", 1), ("a", 1)], "k string, n int")
    rows = sorted((r["position"], r["k"], r["n"]) for r in ordered_positions(df, [F.col("k"), F.col("n")]).collect())
    assert rows == [(0, None, 3), (1, "a", 1), (2, "a", 1), (3, "a", 2), (4, "b", 1)]
    assert ordered_positions(df.limit(0), [F.col("k")]).collect() == []
