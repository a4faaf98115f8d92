"""Shannon entropies, as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType


def _entropy(text: Column, total: Column) -> Column:
    """-sum(p log2 p) over the distinct characters of a text, with p = count / total. A character is counted by what its removal takes away, so long texts cost a few fast passes."""
    size = F.octet_length(text)
    count = lambda c: ((size - F.octet_length(F.replace(text, c, F.lit("")))) / F.octet_length(c)).cast("double") / total
    counts = F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(.)"), F.lit(1))), count)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.aggregate(counts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)))


def byte_entropy(text: Column) -> Column:
    """Over bytes of UTF-8, of a text of any length; an empty one has 0. This is the one that filters compare."""
    letters = F.decode(F.encode(text, "utf-8"), "iso-8859-1")  # a character for each byte
    return _entropy(letters, F.octet_length(text).cast("double"))


def report_entropy(text: Column) -> Column:
    """Character counts over the length in bytes. This is the one that reports show; on ASCII both are equal."""
    return _entropy(text, F.octet_length(text).cast("double"))


def _of_counts(counts: np.ndarray, total: int) -> float:
    p = counts[counts > 0] / total
    return float(-(p * np.log2(p)).sum()) if total else 0.0


@arrow_udf(DoubleType())
def text_byte_entropy(texts: pa.Array) -> pa.Array:
    """``byte_entropy`` of long texts: one pass over the bytes of an Arrow batch, whatever bytes there are. The other form is for short secrets, which stay in the engine."""
    raw = (None if t is None else np.frombuffer(t, dtype=np.uint8) for t in texts.cast(pa.binary()).to_pylist())
    return pa.array([None if t is None else _of_counts(np.bincount(t, minlength=256), len(t)) for t in raw], pa.float64())


@arrow_udf(DoubleType())
def text_report_entropy(texts: pa.Array) -> pa.Array:
    """``report_entropy`` of long texts, in one pass over their characters."""
    found = []
    for t in texts.to_pylist():
        if t is None:
            found.append(None)
            continue
        letters = np.unique(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)[1]
        found.append(_of_counts(letters, len(t.encode("utf-8", "surrogatepass"))))
    return pa.array(found, pa.float64())
