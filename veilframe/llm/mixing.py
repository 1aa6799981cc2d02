"""Mixing sources to target weights by Pareto order sampling.

A source that should give r times its words gives ⌊r⌋ whole copies of every document, and one more of some of them. Those
are drawn by order sampling (Rosén 1997): document k has the uniform number U_k (a hash of its id) and the inclusion
probability λ_k = r − ⌊r⌋, its rank is

    Q_k = (U_k / (1 − U_k)) / (λ_k / (1 − λ_k)),

and the documents of lowest rank are taken while their words fit into what the source still has to give; one that does not
fit is passed over. λ differs from source to source, and, where an importance is given, from document to document. The
last places go to those documents whose sizes together come nearest to the target.

No source is ever sorted: a histogram of the ranks finds the bucket with the cut, and only that bucket is put in order.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ordered import dense_codes
from .common import fresh, materialize, q, small_side, text_or_empty, word_count

MOST = 3            # copies of a document at most
CYCLE = 3           # the weights of the sources are 1 .. CYCLE, in the order of their names, again and again
SEED = 20240
LAST_PLACES = 24    # documents on each side of a source's last cut that are weighed against each other
NEAR = 0.0005       # the order is gone down until what is left to give is below this share of the target, or nothing fits
NEAR = 0.0005       # the order is gone down until what is left to give is below this share of the target, or nothing fits


def source_targets(sizes: DataFrame, most: int = MOST, cycle: int = CYCLE) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    Sources in code-point order, null last, weigh 1, 2, …, ``cycle``, 1, … and share all words. A target stops at
    ``most`` times its source's size; what is over is shared anew by weight until no target is above.
    """
    totals = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    # numbers by range: no task sorts all names
    codes = dense_codes(totals.withColumn("__all", F.lit(0)), "__all", "source").select(F.col("source").alias("__name"), "code")
    named = codes.count()
    weighed = materialize(
        totals.join(codes, totals.source == F.col("__name"), "left")
        .select("source", "source_size", (F.coalesce("code", F.lit(named)) % cycle + 1).alias("weight")), "weights")
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    # the share of one weight grows as sources stop; it has a last value, since 1 < most
    share = 0.0
    while total:
        full = F.col("weight") * F.lit(share) > F.lit(float(most)) * F.col("source_size")
        stopped, weight = weighed.agg(F.sum(F.when(full, F.col("source_size") * most).otherwise(0)),
                                      F.sum(F.when(full, 0).otherwise(F.col("weight")))).first()
        if not weight:
            break
        new = (total - stopped) / weight
        if new <= share:
            break
        share = new
    return weighed.select("source", "source_size", F.least(F.col("weight") * F.lit(share), F.lit(float(most)) * F.col("source_size"))
                          .alias("target"))


def _digest(id_col: Column, text: Column) -> Column:
    """What a document's draw depends on: rows of one id, or without one, that differ in text have draws of their own."""
    return F.xxhash64(F.lit(SEED), id_col, text)


def _uniform(digest: Column) -> Column:
    """In (0, 1): 52 bits of a hash, moved by half a step."""
    return (F.shiftrightunsigned(digest, 12).cast("double") + 0.5) * F.lit(2.0 ** -52)


def _rank(docs: DataFrame) -> DataFrame:
    """Add ``rank`` and ``whole`` from ``ratio``, ``importance`` and ``digest``; a fraction of 0 has no rank."""
    uniform = _uniform(F.col("digest"))
    odds = uniform / (1 - uniform)
    part = F.col("ratio") - F.floor("ratio")
    chance = F.least(part * F.col("importance"), F.lit(1 - 2.0 ** -30))
    return docs.withColumn("whole", F.floor("ratio")).withColumn("rank", F.when(chance > 0, odds / (chance / (1 - chance))))


def _last_places(rows: pd.DataFrame) -> pd.DataFrame:
    """Of the few documents around a source's cut, those whose sizes together come nearest to what is to be given.

    Subset sums as bits of an integer; where several subsets do, documents of low rank are preferred. Sizes are counted
    in units that keep the sums below 2**22.
    """
    rows = rows.sort_values(["rank", "digest"])
    sizes, need = rows["size"].tolist(), int(rows["need"].iloc[0])
    unit = max(1, sum(sizes) >> 22)
    sizes, need = [x // unit for x in sizes], need // unit
    reach = [1]
    for x in sizes:
        reach.append(reach[-1] | reach[-1] << x)
    below = (reach[-1] & ((1 << need + 1) - 1)).bit_length() - 1
    above = reach[-1] >> need + 1
    gap = (above & -above).bit_length() if above else None
    left = need + gap if gap is not None and gap < need - below else below
    chosen = []
    for k in range(len(sizes) - 1, -1, -1):
        if not reach[k] >> left & 1:
            chosen.append(k)
            left -= sizes[k]
    out = rows.iloc[sorted(chosen)]
    return out[["source", "rank", "digest"]]


PLACE = ("rank", "digest")


def _stretches(open_: DataFrame, state: DataFrame, buckets: int) -> DataFrame:
    """Go down the order of each source of ``state`` (``__s, __from, __gap``) until a document does not fit.

    Only documents behind ``__from`` that are no larger than ``__gap`` are looked at. One row per source that has any:
    the stretch taken ends before ``to`` (null: all of them fit), and leaves ``left`` words to give.
    """
    place = F.struct(*PLACE)
    bucket = F.floor(F.col("rank") / (1 + F.col("rank")) * buckets)
    here = open_.join(small_side(state, 100), F.col("source").eqNullSafe(F.col("__s"))).where(
        (F.col("__from").isNull() | (place > F.col("__from"))) & (F.col("size") <= F.col("__gap")))
    per = here.groupBy("__s", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.first("__gap").alias("__gap"),
                                                          F.first("__from").alias("__from"))
    order = Window.partitionBy("__s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    over = F.col("upto") > F.col("__gap")
    edges = materialize(per.withColumn("upto", F.sum("size").over(order)).groupBy("__s").agg(
        F.first("__from").alias("__from"), F.first("__gap").alias("__gap"), F.min(F.when(over, F.col("bucket"))).alias("__b"),
        F.min(F.when(over, F.col("upto") - F.col("size"))).alias("__before"), F.sum("size").alias("__all")), "edges")
    side = small_side(edges.select(F.col("__s").alias("__e"), "__b", "__before"), 100)
    # rows alike in id and text have one place: they are taken or left together
    edge = (here.join(side, F.col("__s").eqNullSafe(F.col("__e")) & (bucket == F.col("__b")))
            .groupBy("__s", *PLACE, "__before", "__gap").agg(F.sum("size").alias("size"))
            .withColumn("upto", F.col("__before") + F.sum("size").over(
                Window.partitionBy("__s").orderBy(*PLACE).rowsBetween(Window.unboundedPreceding, 0)))
            .where(F.col("upto") > F.col("__gap"))
            .groupBy(F.col("__s").alias("__c")).agg(F.min(place).alias("to"), F.min(F.col("upto") - F.col("size")).alias("held")))
    return edges.join(edge, F.col("__s").eqNullSafe(F.col("__c")), "left").select(
        "__s", F.col("__from").alias("from"), "to", F.col("__gap").alias("limit"), (F.col("__gap") - F.coalesce("held", "__all")).alias("left"))


def _taken(place: Column) -> Column:
    """Whether one of ``stretches`` takes a document."""
    return F.exists("stretches", lambda s: (s["from"].isNull() | (place > s["from"])) & (s["to"].isNull() | (place < s["to"]))
                    & (F.col("size") <= s["limit"]))


def _cuts(ranked: DataFrame, targets: DataFrame, rows: int) -> DataFrame:
    """What each source takes of its order: ``(__s, stretches, weighed, fill)``. A source without any has no row.

    A document that does not fit is passed over, and so is, from there on, all that is larger than what is left to give;
    this goes on until that is below ``NEAR`` of the target or nothing fits. Each round at least leaves less to give than the
    document it stopped at has words, in a random order about half of that. Of the last places, ``weighed`` were taken
    and ``fill`` are to be taken instead.
    """
    open_ = materialize(ranked.where(F.col("rank").isNotNull() & (F.col("size") > 0)).select("source", "size", *PLACE), "open")
    buckets = 1 << max(6, min(20, math.ceil(math.log2(math.sqrt(rows + 1)))))  # both levels grow with the root of the rows
    place = F.struct(*PLACE)
    kind = open_.select(place.alias("p")).schema["p"].dataType
    none = F.array().cast(f"array<{kind.simpleString()}>")
    goals = materialize(targets.select(F.col("source").alias("__s"), (F.col("target") * NEAR).alias("__near"), F.lit(None).cast(kind).alias("__from"),
                                       (F.round("target").cast("long") - F.floor("ratio") * F.col("source_size")).alias("__gap")), "goals")
    state, rounds = goals.where(F.col("__gap") > 0).drop("__near"), []
    while True:
        found = materialize(_stretches(open_, state, buckets), "stretches")
        if found.isEmpty():
            break
        rounds.append(found.withColumn("round", F.lit(len(rounds))))
        near = goals.select(F.col("__s").alias("__g"), "__near")
        state = found.where(F.col("to").isNotNull()).join(near, F.col("__s").eqNullSafe(F.col("__g"))).where(F.col("left") > F.col("__near")) \
            .select("__s", F.col("to").alias("__from"), F.col("left").alias("__gap"))
    if not rounds:
        return goals.limit(0).select("__s", F.array().cast(f"array<struct<from:{kind.simpleString()},to:{kind.simpleString()},limit:bigint>>").alias("stretches"),
                                     none.alias("weighed"), none.alias("fill"))
    facts = materialize(reduce(DataFrame.unionByName, rounds).groupBy("__s").agg(
        F.collect_list(F.struct("from", "to", "limit")).alias("stretches"), F.max_by("left", "round").alias("gap")), "taken")
    marked = open_.join(small_side(facts, 400), F.col("source").eqNullSafe(F.col("__s"))).withColumn("taken", _taken(place))
    places = marked.groupBy("__s", "taken", *PLACE, "gap").agg(F.sum("size").alias("size"))

    def first(some: DataFrame, *by: Column) -> DataFrame:
        return some.withColumn("n", F.row_number().over(Window.partitionBy("__s").orderBy(*by))).where(F.col("n") <= LAST_PLACES)

    last = materialize(first(places.where("taken"), F.desc("rank"), F.desc("digest")), "last")  # LAST_PLACES rows per source at most
    held = last.groupBy(F.col("__s").alias("__h")).agg(F.sum("size").alias("held"), F.collect_list(place).alias("weighed"))
    needs = materialize(facts.join(held, F.col("__s").eqNullSafe(F.col("__h")), "left").select(
        F.col("__s").alias("__h"), (F.col("gap") + F.coalesce("held", F.lit(0))).alias("need"),
        F.coalesce("weighed", none).alias("weighed")), "needs")
    side = small_side(needs.select("__h", "need"), 100)
    others = places.where(~F.col("taken")).join(side, F.col("__s").eqNullSafe(F.col("__h"))).where(F.col("size") <= F.col("need"))
    near = first(others.drop("__h"), F.asc("rank"), F.asc("digest")).unionByName(last.join(side, F.col("__s").eqNullSafe(F.col("__h"))).drop("__h"))
    chosen = (near.select(F.col("__s").alias("source"), *PLACE, "size", "need").groupBy("source")
              .applyInPandas(_last_places, "source string, rank double, digest long"))
    fill = chosen.groupBy("source").agg(F.collect_list(place).alias("fill"))
    return (facts.join(needs, F.col("__s").eqNullSafe(F.col("__h"))).join(fill, F.col("__s").eqNullSafe(F.col("source")), "left")
            .select("__s", "stretches", "weighed", F.coalesce("fill", none).alias("fill")))


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           importance: Column | None = None, most: int = MOST, cycle: int = CYCLE) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies``: how often the mix takes each document.

    Sizes are words; a null text has none, and documents without words are taken as often as whole copies go. A null
    source is a source of its own, the last. ``importance`` (mean 1 within a source) makes the extra copy of a document
    likelier. Rows alike in id and text share their draw: they are taken or left together. Results depend on ids, texts
    and sources only, so reruns agree.
    An empty table gives an empty result. New columns take the place of columns of the same name.
    """
    digest = _digest(q(id_col), text_or_empty(text_col))
    base = docs.select(q(source_col).cast("string").alias("source"), word_count(text_col).alias("size"),
                       (F.lit(1.0) if importance is None else importance.cast("double")).alias("importance"), digest.alias("digest"))
    base = materialize(base, "sizes")
    targets = materialize(source_targets(base, most, cycle), "targets")
    n_sources = targets.count()
    placed = targets.select(F.col("source").alias("__s"), "source_size", "target",
                            F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("ratio"))
    side = small_side(placed, 200, n_sources)
    ranked = _rank(base.join(side, F.col("source").eqNullSafe(F.col("__s"))).drop("__s"))
    cuts = materialize(_cuts(ranked, placed.withColumnRenamed("__s", "source"), base.count()), "chosen")
    facts = small_side(placed.join(cuts.withColumnRenamed("__s", "__c"), F.col("__s").eqNullSafe(F.col("__c")), "left"), 1200, n_sources)
    names = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "copies")]
    inner = fresh(docs, "source", "size", "importance", "digest")
    plain = dict(zip(inner, ("source", "size", "importance", "digest")))
    # the working columns travel in one struct, so that no name of the documents can clash
    whole = docs.select(F.struct(*[q(c) for c in names]).alias("__doc"), q(source_col).cast("string").alias(inner[0]),
                        word_count(text_col).alias(inner[1]),
                        (F.lit(1.0) if importance is None else importance.cast("double")).alias(inner[2]), digest.alias(inner[3]))
    whole = whole.select("__doc", *[F.col(c).alias(n) for c, n in plain.items()])
    placed_docs = _rank(whole.join(facts, F.col("source").eqNullSafe(F.col("__s"))))
    place = F.struct(*PLACE)
    extra = F.col("rank").isNotNull() & (F.col("size") > 0) & F.col("stretches").isNotNull() & (
        (_taken(place) & ~F.array_contains("weighed", place)) | F.array_contains("fill", place))
    many = (F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")).alias("copies")
    return placed_docs.select("__doc", "size", "source_size", "target", many).select("__doc.*", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed corpus: each document as often as ``copies`` says, with the columns of ``docs``. Rules as there."""
    name = fresh(docs, "docs")[0]
    taken = copies(docs.select(F.struct(*[q(c) for c in docs.columns]).alias(name), q(id_col).alias("id"), q(text_col).alias("text"),
                               q(source_col).alias("source")), "id", "text", "source", **options)
    return (taken.where(F.col("copies") > 0)
            .select(name, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("n")).select(f"{name}.*"))


def mixed_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken`` (words, repeats counted)."""
    found = copies(docs.select(q(id_col).alias("doc_id"), q(text_col).alias("text"), q(source_col).alias("source")), "doc_id",
                   "text", "source", **options)
    return found.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
