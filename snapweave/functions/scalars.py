"""Scalar functions as column expressions. Null in, null out, unless said otherwise; no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of the units of a duration text (m is minutes, y is 365 days).
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800, "y": 31_536_000}
KIB = 1024


def content_hash(c: Column) -> Column:
    """Content id: SHA-256 in lower-case hex."""
    return F.sha2(c, 256)


def short_id(c: Column, n_bytes: int) -> Column:
    """The first ``n_bytes`` bytes of a hex id."""
    return F.substring(F.lower(c), 1, 2 * n_bytes)


def is_valid_id(c: Column) -> Column:
    return c.rlike("^[0-9a-fA-F]{64}$")


def format_size(c: Column, precision: int = 3) -> Column:
    """Bytes with binary units; ties round to even."""
    x = c.cast("double")
    out = F.concat(c.cast("string"), F.lit(" B"))
    for unit, power in (("KiB", 1), ("MiB", 2), ("GiB", 3), ("TiB", 4)):
        shown = F.concat(F.format_string(f"%.{precision}f", F.bround(x / float(KIB**power), precision)), F.lit(f" {unit}"))
        out = F.when(c >= KIB**power, shown).otherwise(out)
    return out


def format_count(c: Column, singular: str, plural: str) -> Column:
    return F.concat(c.cast("string"), F.when(c == 1, f" {singular}").otherwise(f" {plural}"))


def format_duration(millis: Column) -> Column:
    """The two largest units of a duration; a zero hour is shown between days and minutes; milliseconds only alone."""
    s = F.floor(millis / 1000)
    d, h, m, sec, ms = F.floor(s / 86_400), F.floor(s % 86_400 / 3600), F.floor(s % 3600 / 60), s % 60, millis % 1000
    part = lambda n, unit, when: F.when(when, F.concat(n.cast("long").cast("string"), F.lit(unit)))
    parts = F.filter(F.array(part(d, "d", d > 0), part(h, "h", (h > 0) | ((d > 0) & (m > 0))), part(m, "m", m > 0), part(sec, "s", sec > 0)), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.array_join(F.slice(parts, 1, 2), " ")).when(ms > 0, F.concat(ms.cast("long").cast("string"), F.lit("ms"))).when(millis.isNotNull(), F.lit("0s"))


def parse_duration(c: Column) -> Column:
    """Seconds of texts like 1y2w3d4h5m6s; null where the text is not of this form; 0 for the empty text."""
    numbers = F.regexp_extract_all(c, F.lit("([0-9]+)[smhdwy]"), F.lit(1))
    units = F.regexp_extract_all(c, F.lit("[0-9]+([smhdwy])"), F.lit(1))
    worth = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])
    total = F.aggregate(F.zip_with(numbers, units, lambda n, u: n.cast("long") * worth[u]), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(c.rlike("^([0-9]+[smhdwy])*$"), total)


def retention_number(text: str) -> int:
    """The number in a retention rule: "all" or a positive number."""
    n = (1 << 63) - 1 if text.strip().lower() == "all" else int(text)
    if n <= 0:
        raise ValueError("a retention number must be above 0")
    return n


def parse_tags(c: Column) -> Column:
    """Comma-separated tags as a sorted set without blanks or empty tags."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")))


def permissions(mode: Column) -> Column:
    """Mode bits as a type letter and nine permission letters."""
    kinds = {0o100000: "-", 0o040000: "d", 0o120000: "l", 0o010000: "p", 0o020000: "c", 0o060000: "b", 0o140000: "s"}
    kind = F.lit("?")
    for bits, letter in kinds.items():
        kind = F.when(mode.bitwiseAND(F.lit(0o170000)) == bits, letter).otherwise(kind)
    has = lambda b: mode.bitwiseAND(F.lit(b)) != 0
    letters = [kind]
    for r, w, x, special, low in ((0o400, 0o200, 0o100, 0o4000, "s"), (0o040, 0o020, 0o010, 0o2000, "s"), (0o004, 0o002, 0o001, 0o1000, "t")):
        letters += [F.when(has(r), "r").otherwise("-"), F.when(has(w), "w").otherwise("-")]
        letters.append(F.when(has(x) & has(special), low).when(has(x), "x").when(has(special), low.upper()).otherwise("-"))
    return F.when(mode.isNotNull(), F.concat(*letters))


def show_time(ts: Column) -> Column:
    """Date and time to the second; null before 1970."""
    return F.when(F.year(ts) >= 1970, F.date_format(ts, "yyyy-MM-dd HH:mm:ss"))


def percent_decode(c: Column) -> Column:
    """Null where an escape is malformed."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def parse_url(c: Column) -> Column:
    """Struct of scheme, username, password, host, port, path (array), query, fragment; null where the text is no URL.

    Without "//" after the scheme the rest is one opaque path. Hosts and schemes are in lower case, "." and ".." segments
    are folded, brackets around IPv6 hosts go, ``file`` has no host.
    """
    t = F.trim(c)
    scheme = F.lower(F.regexp_extract(t, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(t, "^[A-Za-z][A-Za-z0-9+.-]*:", "")
    tree = rest.startswith("//")
    body = F.when(tree, F.substring(rest, 3, 1 << 30))
    is_file = scheme == "file"
    authority = F.when(tree & ~is_file, F.regexp_extract(body, "^[^/?#]*", 0)).otherwise(F.lit(""))
    tail = F.when(is_file, body).otherwise(F.regexp_replace(body, "^[^/?#]*", ""))
    info = F.when(authority.contains("@"), F.regexp_extract(authority, "^([^@]*)@", 1))
    place = F.regexp_replace(authority, "^[^@]*@", "")
    v6 = place.startswith("[")
    port_text = F.when(v6, F.when(place.rlike(r"^\[[^\]]+\]:"), F.regexp_extract(place, r"^\[[^\]]+\]:(.*)$", 1))).otherwise(F.when(place.rlike(":[0-9]*$"), F.regexp_extract(place, ":([0-9]*)$", 1)))
    host = F.when(v6, F.regexp_extract(place, r"^\[([^\]]+)\]", 1)).otherwise(F.lower(F.regexp_replace(place, ":[0-9]*$", "")))
    port = F.expr("cast(null as int)")
    port = F.when(port_text.rlike("^[0-9]{1,5}$"), port_text.cast("int")).otherwise(port)
    good = t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & (port_text.isNull() | (port.isNotNull() & (port <= 65_535))) & (~v6 | place.rlike(r"^\[[^\]]+\](:.*)?$"))
    fragment = F.when(tail.contains("#"), F.regexp_extract(tail, "#([\\s\\S]*)$", 1))
    no_fragment = F.regexp_replace(tail, "#[\\s\\S]*$", "")
    query = F.when(no_fragment.contains("?"), F.regexp_extract(no_fragment, r"\?([\s\S]*)$", 1))
    raw = F.regexp_replace(no_fragment, r"\?[\s\S]*$", "")
    raw = F.when(is_file, raw).otherwise(F.regexp_replace(raw, "^/", ""))
    folded = F.aggregate(
        F.when(raw == "", F.array().cast("array<string>")).otherwise(F.split(raw, "/")), F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(percent_decode(s)))),
    )
    username = F.when(info.isNotNull(), percent_decode(F.regexp_replace(info, ":.*$", ""))).otherwise(F.lit(""))
    password = F.when(info.contains(":"), percent_decode(F.regexp_extract(info, "^[^:]*:(.*)$", 1)))
    opaque = F.struct(
        scheme.alias("scheme"), F.lit("").alias("username"), F.lit(None).cast("string").alias("password"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("int").alias("port"),
        F.array(percent_decode(rest)).alias("path"), F.lit(None).cast("string").alias("query"), F.lit(None).cast("string").alias("fragment"),
    )
    full = F.struct(
        scheme.alias("scheme"), username.alias("username"), password.alias("password"), F.when(~is_file, host).alias("host"), F.when(~is_file, port).alias("port"), folded.alias("path"),
        query.alias("query"), fragment.alias("fragment"),
    )
    return F.when(good & tree, full).when(t.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") & ~tree, opaque)


def storage_place(c: Column) -> Column:
    """Struct of kind (local, sftp or unsupported), user, host, port (22 unless given), path."""
    u = parse_url(c)
    null = F.lit(None).cast("string")
    local = lambda p: F.struct(F.lit("local").alias("kind"), null.alias("user"), null.alias("host"), F.lit(None).cast("int").alias("port"), p.alias("path"))
    remote = F.struct(F.lit("sftp").alias("kind"), u["username"].alias("user"), u["host"].alias("host"), F.coalesce(u["port"], F.lit(22)).alias("port"), F.array_join(u["path"], "/").alias("path"))
    other = F.struct(F.lit("unsupported").alias("kind"), null.alias("user"), null.alias("host"), F.lit(None).cast("int").alias("port"), null.alias("path"))
    return F.when(~c.contains("://"), local(c)).when(u["scheme"] == "sftp", remote).when(u["scheme"] == "file", local(F.array_join(u["path"], "/"))).when(c.isNotNull(), other)


def padded_descriptors(n: Column, multiple: int = 64) -> Column:
    """Descriptors in a pack header: the count rounded up to a multiple; none for none."""
    return n + F.pmod(-n, F.lit(multiple))


def header_bytes(n: Column, multiple: int = 64, entry: int = 37) -> Column:
    return padded_descriptors(n, multiple) * entry
