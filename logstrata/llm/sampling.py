"""Bounded samples of rows, for fitting only. The bounds are parameters: rows, and bytes of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FITTED_BYTES = 32 << 20
WHOLE = 1 << 62


def drawn(key: Column, share: float, seed: int = 7) -> Column:
    """Whether a row is of the ``share`` that a 62-bit hash of its key draws; any share above 2**-62 draws rows of a large enough table."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(WHOLE)) < F.lit(min(WHOLE, max(1, int(share * WHOLE))))


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = FITTED_BYTES):
    """Lists of texts (bytes) and labels: about ``most`` rows and ``most_bytes`` bytes at most, chosen by a hash of their id. Ids of several labels take the greatest."""
    ids = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).alias("_label"))
    share = min(1.0, most / max(1, ids.count()))
    chosen = ids.filter(drawn(F.col(id_col), share))
    rows = docs.select(id_col, F.col(text_col).alias("_text")).join(F.broadcast(chosen), id_col)  # ``most`` ids or so
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()
    if n > most or size > most_bytes:  # ids that repeat, or long texts
        rows = rows.filter(drawn(F.col(id_col), share * min(most / max(1, n), most_bytes / max(1, size))))
    rows = rows.select(id_col, "_text", "_label").toArrow()
    from logstrata.llm.hashing import texts_of

    import pyarrow as pa

    texts, marks, names = texts_of(rows.column("_text").combine_chunks()), rows.column("_label").to_pylist(), rows.column(id_col).to_pylist()
    del rows
    pa.default_memory_pool().release_unused()
    order = sorted(range(len(names)), key=lambda i: (names[i], texts[i]))  # the fit doesn't depend on the order of arrival
    return [texts[i] for i in order], [int(marks[i]) for i in order]


def trimmed() -> None:
    """Gives freed memory back to the system, where the C library can: a fit's arrays and texts else stay the driver's."""
    import ctypes

    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
