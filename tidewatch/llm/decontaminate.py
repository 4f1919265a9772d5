"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Names in the middle of a sentence, numbers and numbers with units become typed placeholders. Windows of the resulting
word sequences are hashed and joined with those of the benchmark's items, so a question asked again with other numbers
or names still meets its item. The values behind the placeholders are then compared: the same value of the item must
stand for the same value in the document.

What is taken for a name depends on letter case and on what stands before it. So windows of the plain lower-cased words
go beside those of the template through the same join; they find copies in capitals or in small letters, and need no
comparison of values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewatch.llm.common import stored

NAME = r"(?<=[\p{Ll}\p{Nd},;]\x20)\p{Lu}\p{L}+"
# Units that belong to the number before them.
UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mi|ft|h|hr|hrs|min|s|sec|ms|l|ml|percent|dollars|euros|cents|years|days|hours|minutes|seconds|meters|miles|degrees"
NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
QUANTITY = rf"[$€£]\x20?{NUMBER}|{NUMBER}(?:\x20?%|\x20?(?:{UNITS})\b)"
SLOT = rf"(?:{QUANTITY})|{NUMBER}"
#: Placeholders of names, quantities and numbers, as they stand among the words.
MARKS = ("⟨name⟩", "⟨quantity⟩", "⟨number⟩")
#: Windows of the template and of the plain words.
TEMPLATE, PLAIN = 0, 1
#: Benchmark windows up to which they are sent to every task (32 bytes each); more are joined by a shuffle.
SENT_WINDOWS = 200_000


def words(text: Column) -> Column:
    """Lower-case words of the template of a text; empty for a null text."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), NAME, f" {MARKS[0]} ")
    t = F.regexp_replace(F.regexp_replace(t, QUANTITY, f" {MARKS[1]} "), NUMBER, f" {MARKS[2]} ")
    return F.filter(F.split(F.lower(t), r"[^\p{L}⟨⟩]+"), lambda w: w != "")


def plain_words(text: Column) -> Column:
    """Lower-case words and numbers of a text as they stand; empty for a null text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{Nd}]+"), lambda w: w != "")


def windows(tokens: Column, sizes: list[int], form: int) -> Column:
    """(size, position, hash) of every run of each size. ``tokens`` may be any expression: it is computed once. Runs of
    different forms have different hashes."""
    return F.flatten(F.transform(F.array(tokens), lambda t: runs(t, sizes, form)))


def runs(tokens: Column, sizes: list[int], form: int) -> Column:
    n = F.size(tokens)

    def of(s: int) -> Column:
        return F.when(n >= s, F.transform(F.sequence(F.lit(0), n - s), lambda i: F.struct(
            F.lit(s).alias("size"), i.alias("at"), F.xxhash64(F.slice(tokens, i + 1, s), F.lit(form)).alias("hash"))))

    empty = F.array().cast("array<struct<size:int,at:int,hash:bigint>>")
    return F.concat(*[F.coalesce(of(s), empty) for s in sizes])


def slots(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, place, value): the value behind each placeholder, by its place among the words.

    Names are taken out first and numbers from what is left, both in text order, as :func:`words` replaces them."""
    t = F.coalesce("text", F.lit(""))
    named = df.select(*keys, words(F.col("text")).alias("w"), F.regexp_extract_all(t, F.lit(NAME), F.lit(0)).alias("names"),
                      F.regexp_extract_all(F.regexp_replace(t, NAME, f" {MARKS[0]} "), F.lit(SLOT), F.lit(0)).alias("numbers"))
    marks = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("place"), (x == MARKS[0]).alias("name"), x.isin(*MARKS).alias("slot"))), lambda s: s["slot"])
    name = F.filter("m", lambda s: s["name"])
    rest = F.filter("m", lambda s: ~s["name"])
    return (named.withColumn("m", marks).where(F.size("m") > 0)
            .select(*keys, F.explode(F.concat(F.arrays_zip(name.alias("s"), F.col("names").alias("value")), F.arrays_zip(rest.alias("s"), F.col("numbers").alias("value")))).alias("z"))
            .select(*keys, F.col("z.s.place").alias("place"), F.lower("z.value").alias("value")).where("place IS NOT NULL AND value IS NOT NULL"))


def occurrences(met: DataFrame, slack: int) -> DataFrame:
    """The rows of ``met`` by the places where an item can stand in a document: ``level`` and ``occurrence`` name them.

    * level 0: windows on one diagonal (place in the document less place in the item), that is one unbroken copy;
    * level 1: diagonals of a text that follow each other by ``slack`` at most, that is a copy with words put in or left out;
    * level 2: all of the document, each window by its first place only.

    The last two are left out where they hold a single diagonal."""
    pair = W.partitionBy("doc_id", "item_id", "form")
    by = pair.orderBy("part", "diagonal", "at")
    new = F.coalesce((F.lag("part").over(by) != F.col("part")) | (F.col("diagonal") - F.lag("diagonal").over(by) > slack), F.lit(False))
    where = F.struct("part", "diagonal")
    marked = (met.withColumn("diagonal", F.col("at") - F.col("item_at")).withColumn("new", new.cast("long"))
              .withColumn("run", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
              .withColumn("several", F.min(where).over(pair) != F.max(where).over(pair))
              .withColumn("nth", F.row_number().over(W.partitionBy("doc_id", "item_id", "form", "hash").orderBy("at", "part", "item_at"))))

    def named(level: int, part: Column, name: Column) -> Column:
        return F.struct(F.lit(level).alias("level"), part.cast("long").alias("within"), name.cast("long").alias("occurrence"))

    own = named(0, F.col("part"), F.col("diagonal"))
    alike = F.when(F.col("several"), named(1, F.col("part"), F.col("run")))
    whole = F.when(F.col("several") & (F.col("nth") == 1), named(2, F.lit(0), F.lit(0)))
    kinds = F.explode(F.filter(F.array(own, alike, whole), lambda x: x.isNotNull())).alias("o")
    return marked.select("doc_id", "item_id", "form", "part", "hash", "at", "item_at", "own", "item_windows", kinds).select("*", "o.*").drop("o")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.5, consistency: float = 0.5, quote: int = 13) -> DataFrame:
    """Documents that hold an item: (doc_id, item_id, n_windows, item_windows, coverage, n_slots, n_changed, kind).

    ``docs`` is (doc_id, text), ``benchmark`` (item_id, text); other columns are ignored, rows without an id are left
    out, rows sharing an id are judged together. A pair is reported if ``coverage`` of the item's windows stand in the
    document and at least ``consistency`` of the item's slot values are each answered by one value only. kind is
    ``verbatim`` if no value changed, else ``reparameterised``. Template and plain words are judged each by itself and the
    better one is given; plain words have no slots (n_slots 0). Items of fewer words than ``window`` are one window of
    their own length; items of one or two words, or none, match nothing.
    """
    named = benchmark.where("item_id IS NOT NULL").select("item_id", "text")
    items = stored(named.select("item_id", "text", F.lit(TEMPLATE).alias("form"), words(F.col("text")).alias("w"))
                   .union(named.select("item_id", "text", F.lit(PLAIN), plain_words(F.col("text")))).where(F.size("w") >= 3))
    short = [r[0] for r in items.where(F.size("w") < window).select(F.size("w").alias("n")).distinct().collect()]  # under `window` numbers
    mine = F.when(F.size("w") < window, F.size("w")).otherwise(window)
    sizes = sorted({window, *short})
    runs_of = F.when(F.col("form") == TEMPLATE, windows(F.col("w"), sizes, TEMPLATE)).otherwise(windows(F.col("w"), sizes, PLAIN))
    item_rows = items.select("item_id", "form", mine.alias("own"), F.explode(runs_of).alias("x")).where("x.size = own").select("item_id", "form", "own", "x.hash", F.col("x.at").alias("item_at"))
    total = item_rows.groupBy("item_id", "form").agg(F.count_distinct("hash").alias("item_windows"))
    item_windows = stored(item_rows.join(total, ["item_id", "form"]))
    sent = F.broadcast if item_windows.count() <= SENT_WINDOWS else lambda df: df
    # rows that share a doc_id are told apart by their text, so that places are places in one text
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("part"), "text")
    both = F.concat(windows(words(F.col("text")), sizes, TEMPLATE), windows(plain_words(F.col("text")), sizes, PLAIN))
    seen = texts.select("doc_id", "part", F.explode(both).alias("x")).select("doc_id", "part", "x.at", "x.hash")
    met = stored(seen.join(sent(item_windows.select("hash").distinct()), "hash", "left_semi")).distinct().join(sent(item_windows), "hash")
    placed = stored(occurrences(met, window))
    one = ["doc_id", "item_id", "form", "level", "within", "occurrence"]
    share = F.col("n_windows") / F.col("item_windows")
    # a quote: so many windows one after the other on one diagonal, that is in item and document alike
    chain = max(1, quote - window + 1)
    at = F.sort_array(F.collect_set(F.when(F.col("level") == 0, F.col("item_at"))))
    quoted = F.when(F.size("places") >= chain, F.exists(F.sequence(F.lit(0), F.size("places") - chain), lambda i: F.get("places", i + chain - 1) - F.get("places", i) == chain - 1)).otherwise(False)
    counted = placed.groupBy(*one).agg(F.count_distinct("hash").alias("n_windows"), F.first("item_windows").alias("item_windows"), F.first("own").alias("own"), at.alias("places"))
    found = stored(counted.where((share >= coverage) | ((F.col("own") == window) & quoted)).select(*one, "n_windows", "item_windows"))
    # values: only of the occurrences that reach the coverage, and only where the item has placeholders
    slotted = slots(items.where(F.col("form") == TEMPLATE).select("item_id", "text"), "item_id").withColumnsRenamed({"place": "item_place", "value": "item_value"})
    aligned = (placed.join(found.where(F.col("form") == TEMPLATE).select(*one), one, "left_semi").join(sent(slotted), "item_id")
               .where("item_place >= item_at AND item_place < item_at + own")
               .select(*one, "part", (F.col("at") + F.col("item_place") - F.col("item_at")).alias("place"), "item_value").distinct())
    flagged = aligned.select("doc_id", "part").distinct()
    values = slots(texts.join(flagged, ["doc_id", "part"], "left_semi").distinct(), "doc_id", "part")
    answers = (aligned.join(values, ["doc_id", "part", "place"]).groupBy(*one, "item_value")
               .agg(F.count_distinct("value").alias("n"), F.max(F.col("value") != F.col("item_value")).alias("changed"))
               .groupBy(*one).agg(F.count(F.lit(1)).alias("n_slots"), F.sum(F.col("changed").cast("long")).alias("n_changed"),
                                  F.avg((F.col("n") == 1).cast("double")).alias("same")))
    out = found.join(answers, one, "left").where(F.coalesce("same", F.lit(1.0)) >= consistency)
    changed = F.coalesce("n_changed", F.lit(0)).cast("long")
    best = F.struct(share.alias("coverage"), (-changed).alias("unchanged"), (-F.col("form")).alias("form"), "n_windows", "item_windows",
                    F.coalesce("n_slots", F.lit(0)).cast("long").alias("n_slots"), changed.alias("n_changed"))
    kind = F.when(F.col("b.n_changed") == 0, "verbatim").otherwise("reparameterised")
    return out.groupBy("doc_id", "item_id").agg(F.max(best).alias("b")).select(
        "doc_id", "item_id", "b.n_windows", "b.item_windows", "b.coverage", "b.n_slots", "b.n_changed", kind.alias("kind"))
