"""Secrets told apart by how many repositories and owners hold them.

Candidates are found with regular expressions; their hashes are aggregated by
distinct repositories and owners over the corpus. A value that one owner has
looks live; one that many owners have is a copied example. DataFrame
functions only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leakflow.llm.staging import stage, with_row_id
from leakflow.operators.matching import named, running, spans


@dataclass(frozen=True)
class Kind:
    """A pattern; ``group`` holds the secret and must have ``least`` characters. ``needs`` are patterns that it must contain."""

    name: str
    pattern: str
    group: int
    least: int
    needs: tuple[str, ...] = ()


def _either(word: str) -> str:
    """A pattern for a word in ASCII letters of either case; Unicode's further case pairs don't match."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

#: In the order in which spans with equal starts are listed. Runs of one class are matched with their least length at once: shorter runs fail anyway.
BASE = (
    Kind("assign", f"({_NAMES})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Candidates of the method: long runs with capitals, small letters and digits. They become spans only if one owner has them.
OWNED = Kind("owned", r"[A-Za-z0-9+/_-]{20,}", 0, 20, ("[A-Z]", "[a-z]", "[0-9]"))


SPANS = "array<struct<start:int,ord:int,kind:string,end:int,print:string>>"
#: A secret that is at least this often there, and in at least a hundred-thousandth of all places, is looked up by broadcast: there are 100,000 of them at most.
HOT_PLACES, HOT_SHARE = 10_000, 100_000


def found_spans(text: Column, kind: Kind, order: int) -> Column:
    """array<struct<start, ord, kind, end, print>>: leftmost non-overlapping matches, in code points; ``print`` is the secret's SHA-256. The work grows with the text and its matches."""
    needed = lambda s: reduce(lambda a, n: a & s["secret"].rlike(n), kind.needs, F.length(s["secret"]) >= kind.least)
    good = F.filter(spans(text, kind.pattern, kind.group), needed)
    made = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind.name).alias("kind"), s["end"].alias("end"), F.sha2(s["secret"], 256).alias("print")))
    return made.cast(SPANS)


def outside(more: Column, base: Column) -> Column:
    """Those of ``more`` that overlap none of ``base``; in the order of their starts.

    Among all in order, a span overlaps one before it if some base ends
    behind its start, and one after it if some base begins before its end.
    """
    whole = 1 << 30
    in_base = lambda s: s["ord"] < len(BASE)

    def kept(sorted_: Column) -> Column:
        ends = running(F.transform(sorted_, lambda s: F.when(in_base(s), s["end"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
        starts = F.reverse(running(F.reverse(F.transform(sorted_, lambda s: F.when(in_base(s), s["start"]).otherwise(whole))), F.lit(whole), lambda a, b: F.least(a, b)))
        rows = F.arrays_zip(sorted_.alias("s"), ends.alias("to"), starts.alias("begin"))
        return F.transform(F.filter(rows, lambda r: ~in_base(r["s"]) & (r["to"] <= r["s"]["start"]) & (r["begin"] >= r["s"]["end"])), lambda r: r["s"])

    return F.when((F.size(more) > 0) & (F.size(base) > 0), named(F.array_sort(F.concat(base, more)), kept)).otherwise(more)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = 1, max_repositories: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied for each row of ``docs``.

    A candidate is live if at most ``max_owners`` owners and
    ``max_repositories`` repositories hold its secret anywhere in the corpus,
    otherwise copied. ``spans`` lists all base spans, and of the further
    candidates (outside base spans) those that are live. n_live and n_copied
    count a row's candidates of either sort, base ones included.

    A null text is empty; null owners and repositories count as one owner and
    one repository each. Repeated rows each return a row (and are one owner);
    an empty table returns none. Texts may be of any length and hold any
    number of matches.
    """
    column = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    repo = F.concat_ws("\x1f", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in repository))
    base = F.concat(*(found_spans(column, k, i) for i, k in enumerate(BASE)))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id_"), F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit("\x1e")).alias("owner_"), repo.alias("repo_"), F.array_sort(base).alias("base_"), found_spans(column, OWNED, len(BASE)).alias("more_"))
    staged = stage(with_row_id(rows.withColumn("more_", outside(F.col("more_"), F.col("base_"))), "row_id_"), "spans")
    candidates = staged.filter((F.size("base_") > 0) | (F.size("more_") > 0)).select("row_id_", "owner_", "repo_", F.explode(F.concat("base_", "more_")).alias("s")).select("row_id_", "owner_", "repo_", "s.*")
    # one row for each holder first, so that a value that is everywhere meets only its distinct holders
    holders = candidates.groupBy("print", "owner_", "repo_").agg(F.count("*").alias("n"))
    spread = holders.groupBy("print").agg(F.count_distinct("owner_").alias("owners"), F.count_distinct("repo_").alias("repositories"), F.sum("n").alias("places"))
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    told = stage(spread.select("print", live.alias("live"), "places"), "spread")
    # a value that is everywhere never is the key of a shuffle: those are few, whatever the corpus, so they are broadcast
    often = max(HOT_PLACES, (told.agg(F.sum("places")).first()[0] or 0) // HOT_SHARE)
    hot = F.broadcast(told.filter(F.col("places") >= often).select("print", "live"))
    rest = told.filter(F.col("places") < often).select("print", "live")
    judged = candidates.join(hot, "print").unionByName(candidates.join(hot, "print", "left_anti").join(rest, "print"))
    shown = (F.col("ord") < len(BASE)) | F.col("live")
    by_row = judged.groupBy("row_id_").agg(
        F.array_sort(F.collect_list(F.when(shown, F.struct("start", "ord", "kind", "end")))).alias("spans_"),
        F.sum(F.col("live").cast("long")).alias("live_"), F.sum((~F.col("live")).cast("long")).alias("copied_"),
    )
    number = lambda name: F.size(F.filter("base_", lambda s: s["kind"] == name)).cast("long")
    return staged.join(by_row, "row_id_", "left").select(
        F.col("id_").alias(doc_id), *(number(k.name).alias(f"n_{k.name}") for k in BASE), F.sha2(_listed(F.col("base_")), 256).alias("base_sha256"),
        F.coalesce(_listed(F.col("spans_")), F.lit("")).alias("spans"), F.coalesce("live_", F.lit(0).cast("long")).alias("n_live"), F.coalesce("copied_", F.lit(0).cast("long")).alias("n_copied"),
    )
