"""Secret scans with corpus-wide ownership frequencies, in DataFrame functions only.

Every whole text is scanned once for candidates: assignments to secret names, access
key ids, long hexadecimal runs (these three are the base kinds), and other long runs
of letters and digits. Candidates are hashed and counted over the corpus by distinct
repositories and owners. One that several owners hold is a copied example; one of a
single owner looks live. Base candidates are always reported; a run of the fourth
kind is added, as kind `owned`, if it overlaps no base span and has a single owner.

A scan's narrow result (ids and spans) is kept in the shared folder, so that texts
are read and matched once. Counts are pre-aggregated by task and by owner before
hashes meet. Joins of frequent hashes have one row per hash on the other side, and
adaptive execution splits them.

Matches are leftmost and do not overlap within a kind; positions are code points,
ends exclusive.

Defined results: a NULL text is empty. A NULL owner is an owner of its own, as is a
NULL repository. Repeated rows are scanned each and count once as a repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timelens.llm.store import kept as stored


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_any_case(w) for w in ("password", "passwd", "secret", "token"))
ASSIGN = rf"({_NAMES}|{_any_case('api')}_?{_any_case('key')})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
# For these two, asking for the least length in the pattern finds the same matches as dropping short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
RUN = r"[A-Za-z0-9_-]{20,}"

KINDS = ("assign", "access", "hex", "owned")
LEAST_ASSIGNED = 6
EXAMPLE_OWNERS = 2
"""Owners from which on a candidate is an example."""


def spans(text: Column, kind: str, pattern: str, kept) -> Column:
    """start, rank, end, value of all matches in order, as far as `kept(value)` holds.

    A match starts behind the pieces between the matches before it and those matches.
    """
    rank = KINDS.index(kind)
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("CAST(array() AS array<struct<start: bigint, rank: int, end: bigint, value: string>>)")

    def add(held: Column, x: Column) -> Column:
        start = held["at"] + F.length(x["piece"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), x["match"].alias("value"))
        return F.struct(end.alias("at"), F.concat(held["spans"], F.array(span)).alias("spans"))

    walked = F.aggregate(
        F.zip_with(F.slice(between, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("piece"), m.alias("match"))),
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), add, lambda held: held["spans"])
    return F.when(text.rlike(pattern), F.filter(walked, lambda s: kept(s["value"]))).otherwise(none)


def find_candidates(documents: DataFrame, repository: str, owner: str) -> DataFrame:
    """row_id, repository, owner, base and runs of every row, in the shared folder."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    every = lambda value: F.lit(True)
    return stored(
        documents.select(
            F.monotonically_increasing_id().alias("row_id"), F.col(repository).alias("repository"), F.col(owner).alias("owner"),
            spans(text, "assign", ASSIGN, lambda v: F.length(F.regexp_extract(v, ASSIGN, 2)) >= LEAST_ASSIGNED).alias("assign"),
            spans(text, "access", ACCESS, every).alias("access"), spans(text, "hex", HEX, every).alias("hex"),
            spans(text, "owned", RUN, lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")).alias("runs"))
        .select("row_id", "repository", "owner", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), "runs")
        .withColumn("runs", F.filter("runs", lambda r: ~F.exists(
            "base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))))


def _secret(span: Column) -> Column:
    """What is hashed: the assigned value, or the whole match."""
    return F.when(span["rank"] == 0, F.regexp_extract(span["value"], ASSIGN, 2)).otherwise(span["value"])


def ownership(candidates: DataFrame) -> DataFrame:
    """n_repositories and n_owners of every candidate hash."""
    seen = candidates.select("hash", "owner", "repository").distinct()
    return (seen.groupBy("hash", "owner").agg(F.count("*").alias("held"))
            .groupBy("hash").agg(F.sum("held").alias("n_repositories"), F.count("*").alias("n_owners")))


def scan_secrets(documents: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """Per row: repository, owner, base and all spans (start, rank of KINDS, end, value; sorted),
    and how many of all spans look live (`n_live`) or are copied examples (`n_copied`)."""
    found = find_candidates(documents, repository, owner)
    each = (found.where((F.size("base") > 0) | (F.size("runs") > 0))
            .select("row_id", "repository", "owner", F.explode(F.concat("base", "runs")).alias("span"))
            .withColumn("hash", F.xxhash64(_secret(F.col("span")))))
    judged = (each.join(ownership(each), "hash")
              .withColumn("copied", F.col("n_owners") >= EXAMPLE_OWNERS)
              .where((F.col("span.rank") < KINDS.index("owned")) | ~F.col("copied"))
              .groupBy("row_id").agg(F.array_sort(F.collect_list("span")).alias("spans"),
                                     F.count_if("copied").alias("n_copied"), F.count_if(~F.col("copied")).alias("n_live")))
    return (found.join(judged, "row_id", "left")
            .select("repository", "owner", "base", F.coalesce("spans", "base").alias("spans"),
                    F.coalesce("n_copied", F.lit(0)).alias("n_copied"), F.coalesce("n_live", F.lit(0)).alias("n_live")))


def as_text(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
