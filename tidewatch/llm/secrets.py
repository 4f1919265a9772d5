"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong findings (assigned secrets, access identifiers, long hex strings) are always reported. Weak candidates
(identifiers, opaque strings, endpoints) are reported only where the parts that complete them stand in the same scope,
a number of characters before or behind them: an opaque string with an identifier, an identifier with a secret, an endpoint
with both. Parts do not overlap what they complete. The interval join is a range frame over the ends of a text's spans, so no
pairs are made.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.llm.common import stored


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # leftmost matches that do not overlap
    group: int = 0  # the group whose length counts
    least: int = 1
    strong: bool = False
    needs: tuple[str, ...] = ()  # roles that must stand in the scope of a weak candidate
    role: str = "secret"


# Patterns of the strong kinds. A run of the hex or access alphabet that is too short can hold no later
# match, so their least lengths stand in the pattern itself.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Kind("access", r"AKIA[A-Z0-9]{12,}", 0, 16, True, role="identifier"),
    Kind("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Kind("identifier", r"""(?i)\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@-]{3,}""",
         needs=("secret",), role="identifier"),
    Kind("opaque", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[A-Z0-9+/_-]*[a-z])(?=[a-z0-9+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}",
         needs=("identifier",)),
    Kind("endpoint", r"""(?i)\b(?:(?:https?|ftps?|ssh|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]{4,}|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]{4,})""",
         needs=("identifier", "secret"), role="endpoint"),
)


def found(kind: Kind) -> Column:
    """Matches of a kind in text order: characters before each since the last, its own, and those of its group.

    split() gives one more piece than there are matches, so the pieces' lengths tell where the matches stand."""
    p = F.lit(kind.pattern)
    before = F.transform(F.split("text", kind.pattern, -1), F.length)
    own = F.transform(F.regexp_extract_all("text", p, F.lit(0)), F.length)
    group = F.transform(F.regexp_extract_all("text", p, F.lit(kind.group)), F.length) if kind.group else own
    return F.when(F.col("text").rlike(kind.pattern), F.slice(F.arrays_zip(before.alias("before"), own.alias("own"), group.alias("group")), F.lit(1), F.size(own)))


def spans(docs: DataFrame, scope: int = 400, kinds: tuple[Kind, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): the rows of ``docs`` numbered (row, doc_id), and their reported spans (row, rank, kind, start,
    end, strong), in code points with the end exclusive. A null text has none."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", *[found(k).alias(k.name) for k in kinds]))

    def numbered(rank: int, kind: Kind) -> Column:
        return F.coalesce(F.transform(kind.name, lambda m, i: F.struct(F.lit(rank).alias("rank"), i.alias("i"), m["before"].alias("before"),
                                                                       m["own"].alias("own"), m["group"].alias("group"))), none)

    none = F.array().cast("array<struct<rank:int,i:int,before:int,own:int,group:int>>")
    one = F.concat(*[numbered(r, k) for r, k in enumerate(kinds)])
    each = rows.select("row", F.explode(one).alias("m")).select("row", "m.*")
    w = W.partitionBy("row", "rank").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("before") + F.col("own")).over(w)
    named = F.array(*[F.lit(k.name) for k in kinds])[F.col("rank")]
    least = F.array(*[F.lit(k.least) for k in kinds])[F.col("rank")]
    strong = F.array(*[F.lit(k.strong) for k in kinds])[F.col("rank")]
    placed = each.withColumn("end", end).where(F.col("group") >= least).select(
        "row", "rank", named.alias("kind"), (F.col("end") - F.col("own")).alias("start"), "end", strong.alias("strong"))
    # a candidate that lies inside a strong span is that span
    inside = F.max(F.when(F.col("strong"), F.col("end"))).over(W.partitionBy("row").orderBy("start", F.desc("strong"), F.desc("end")).rowsBetween(W.unboundedPreceding, 0))
    apart = F.coalesce(inside <= F.col("start"), F.lit(True))
    placed = placed.withColumn("reported", F.col("strong") | apart)
    # first with every candidate as a part, then with those that found theirs
    for _ in range(2):
        placed = complemented(placed, kinds, scope)
    return rows.select("row", "doc_id"), placed.where("reported").select("row", "rank", "kind", "start", "end", "strong")


def complemented(placed: DataFrame, kinds: tuple[Kind, ...], scope: int) -> DataFrame:
    """``placed`` with weak spans still reported only if for each role they need a reported span of it ends at most ``scope``
    characters before them or starts as near behind them. So no part overlaps the span it completes, and one string is never
    two parts. Each span is two points of its text, and a range frame over the points is the interval join."""
    roles = ("identifier", "secret", "endpoint")
    role = F.array(*[F.lit(k.role) for k in kinds])[F.col("rank")]
    points = placed.withColumn("role", role).withColumn("p", F.explode(F.array(
        F.struct(F.col("start").alias("at"), F.lit(True).alias("opens")), F.struct(F.col("end").alias("at"), F.lit(False).alias("opens"))))).select("*", "p.*")
    near = W.partitionBy("row").orderBy("at")

    def met(r: str) -> Column:
        part = (F.col("role") == r) & F.col("reported")
        behind, ahead = F.max(part & ~F.col("opens")).over(near.rangeBetween(-scope, 0)), F.max(part & F.col("opens")).over(near.rangeBetween(0, scope))
        return F.when(F.col("opens"), behind).otherwise(ahead)

    both = points.withColumns({f"_{r}": met(r) for r in roles}).groupBy("row", "rank", "kind", "start", "end", "strong", "reported").agg(
        *[F.max(f"_{r}").alias(f"_{r}") for r in roles])
    complete = F.lit(False)
    for i, k in enumerate(kinds):
        if not k.strong:
            has = F.lit(True)
            for r in k.needs:
                has = has & F.col(f"_{r}")
            complete = complete | ((F.col("rank") == i) & has)
    return both.withColumn("reported", F.col("strong") | (F.col("reported") & complete)).drop(*[f"_{r}" for r in roles])


def joined(items: Column) -> Column:
    ordered = F.array_sort(F.collect_list(items))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, scope: int = 400) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others ignored): counts of the strong kinds, a digest of their spans, all spans.

    Rows without findings, also null and empty texts, have zero counts and an empty list. A text's spans are gathered in
    one row, as the result asks; they are never more than its length allows.
    """
    rows, found_ = spans(docs, scope)
    span = F.struct("start", "rank", "kind", "end")
    counts = [F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    per_row = found_.groupBy("row").agg(*counts, joined(F.when(F.col("strong"), span)).alias("base"), joined(span).alias("spans"))
    return rows.join(per_row, "row", "left").select(
        "doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def masked(docs: DataFrame, mask: str, scope: int = 400) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mask`` (overlapping spans by one), n_chars recounted.

    The other columns and rows stay as they are, whatever their names; a null text stays null.
    """
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        return name if name not in taken else free(f"_{name}")

    row_, spans_ = free("_row"), free("_spans")
    kept = stored(docs.withColumn(row_, F.monotonically_increasing_id()))
    rows, found_ = spans(kept.select(F.col(row_).alias("doc_id"), "text"), scope)
    w = W.partitionBy("row").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(W.unboundedPreceding, -1))
    runs = found_.withColumn("fresh", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int")).withColumn("run", F.sum("fresh").over(w.rowsBetween(W.unboundedPreceding, 0)))
    merged = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    per_row = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans_)).join(rows, "row").select(F.col("doc_id").alias(row_), spans_)
    upto = lambda i: F.when(i > 0, F.get(F.col(spans_), i - 1)["end"]).otherwise(0)
    pieces = F.transform(spans_, lambda s, i: F.concat(F.substr("text", upto(i) + 1, s["start"] - upto(i)), F.lit(mask)))
    rest = F.substr(F.col("text"), F.element_at(spans_, -1)["end"] + 1)
    text = F.when(F.col(spans_).isNull(), F.col("text")).otherwise(F.concat(F.array_join(pieces, ""), rest))
    changed = kept.join(per_row, row_, "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.col(spans_).isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)
