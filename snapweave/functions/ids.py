"""Content ids: 64 hex digits in text, 32 bytes as join keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longer than any well-formed key, so that a malformed id never equals one.
_ZEROS = "00" * 33


def id_key(c: Column | str) -> Column:
    """32 bytes of a well-formed id in either letter case; malformed ids keep their lower-case text behind 33 zero bytes. Null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    raw = F.unhex(c)
    return F.when((F.length(c) == 64) & raw.isNotNull(), raw).otherwise(F.concat(F.unhex(F.lit(_ZEROS)), F.encode(F.lower(c), "UTF-8")))


def id_text(c: Column | str) -> Column:
    """Inverse of id_key: the id in lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.octet_length(c) == 32, F.lower(F.hex(c))).otherwise(F.decode(F.substring(c, 34, 1 << 30), "UTF-8"))
