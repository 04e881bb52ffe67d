"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_totals, write_once

EPOCHS = 3
WEIGHTS = (5, 2, 1)
WORD = "[^\\x20\\x09-\\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: ``source, source_size, before, weight, target``.

    ``sizes`` has ``source`` and ``size``. Sources are ordered by code point, null last; ``before`` is the size of
    all earlier sources, and weights repeat along the order. Targets share the total size by weight, but none is
    above ``epochs`` times its source's size; what they leave goes to the others by weight. The shares are found
    from the sources in the order of ``cap / weight``: the first ones that a common level would lift above
    their caps are capped, the level of the rest follows from what remains.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = [F.asc_nulls_last("source")]
    one = running_totals(totals.withColumn("_one", F.lit(1)), by_name, {"_upto": "source_size", "_nth": "_one"})
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_nth") - 1) % len(weights) + 1).cast("int"))
    ranked = one.select(
        "source", "source_size", (F.col("_upto") - F.col("source_size")).alias("before"), weight.alias("weight"), "_nth"
    ).withColumn("cap", F.col("source_size") * epochs)
    ranked = ranked.withColumn("full_at", F.col("cap") / F.col("weight"))
    filled = write_once(running_totals(ranked, ["full_at", "_nth"], {"_caps": "cap", "_weights": "weight"}))
    whole = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    rest = (F.lit(whole.size) - (F.col("_caps") - F.col("cap"))) / (F.lit(whole.weight) - (F.col("_weights") - F.col("weight")))
    capped = filled.withColumn("_capped", F.col("full_at") <= rest)
    full = capped.filter("_capped").agg(F.sum("cap").alias("size"), F.sum("weight").alias("weight")).first()
    size, weight = (whole.size or 0) - (full.size or 0), (whole.weight or 0) - (full.weight or 0)
    level = F.lit(size / weight if weight else 0.0)
    target = F.when(F.col("_capped"), F.col("cap").cast("double")).otherwise(level * F.col("weight"))
    return capped.select("source", "source_size", "before", "weight", target.alias("target"))


def fair_mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = "mix", columns: tuple[str, ...] = ()
) -> DataFrame:
    """How many words of each document the mix takes: ``doc_id, source, size, source_size, target, taken``.

    ``docs`` has ``doc_id``, ``text`` and ``source``; ``columns`` are carried along unchanged. Documents of a source
    are put in a pseudo-random order (md5 of seed and id) and repeated up to ``epochs`` times. A copy's virtual
    finish time is the cumulative size of its source up to it, divided by the source's target. All copies are
    range-sorted by finish time (a source queues no copy that would start after its target is met) and the queue
    is cut where the running total reaches the size of all documents; the copy at the cut gives the words that are
    still missing. ``taken`` adds up a document's copies.

    Null and empty texts have size 0 and taken 0; a null source is a source of its own; null ids are shuffled
    together; repeated rows count each for itself; an empty table gives no rows. Ties end in the row's place in
    the shuffled order, so reruns agree. A source of any size is spread over many ranges.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), docs["doc_id"].cast("string"))).alias("_key")
    size = F.regexp_count(F.coalesce(docs["text"], F.lit("")), F.lit(WORD)).cast("long").alias("size")
    carried = F.struct(*[docs[c] for c in columns] or [F.lit(0).alias("none")]).alias("_carried")
    sized = write_once(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), size, key, carried))
    targets = write_once(source_targets(sized, weights, epochs))
    order = [F.asc_nulls_last("source"), F.col("_key"), F.asc_nulls_last("doc_id"), F.col("size")]
    queue = running_totals(sized.withColumn("_one", F.lit(1)), order, {"_upto": "size", "_place": "_one"})
    names = targets.withColumnRenamed("source", "_source")
    queue = write_once(
        queue.join(names, F.col("source").eqNullSafe(F.col("_source")), "left").select(
            "doc_id", "source", "size", "source_size", "target", "_place", (F.col("_upto") - F.col("before")).alias("_cum"), "_carried"
        )
    )

    def finish(epoch):
        return (F.col("source_size") * epoch + F.col("_cum")) / F.col("target")

    def queued(epoch):
        return F.col("source_size") * epoch + F.col("_cum") - F.col("size") < F.col("target")

    copies = (
        queue.filter("size > 0 AND target > 0")
        .select("size", "source_size", "target", "_cum", "_place", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("_epoch"))
        .filter(queued(F.col("_epoch")))
        .select("size", "_place", "_epoch", finish(F.col("_epoch")).alias("_finish"))
    )
    served = running_totals(copies, ["_finish", "_place", "_epoch"], {"_served": "size"})
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    last = served.filter(F.col("_served") >= budget).agg(F.min(F.struct("_finish", "_place", "_epoch", "_served")).alias("cut")).first().cut
    last = last or (0.0, 0, 0, budget)
    at = F.struct(F.lit(last[0]).alias("_finish"), F.lit(last[1]).cast("long").alias("_place"), F.lit(last[2]).alias("_epoch"))
    parts = []
    for epoch in range(epochs):
        here = F.struct(finish(epoch).alias("_finish"), F.col("_place"), F.lit(epoch).alias("_epoch"))
        part = F.when(here < at, F.col("size")).when(here == at, F.col("size") - (last[3] - budget))
        parts.append(F.when(queued(epoch), F.coalesce(part, F.lit(0))).otherwise(F.lit(0)))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), sum(parts[1:], parts[0])).otherwise(F.lit(0)).cast("long")
    return queue.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *[F.col(f"_carried.{c}").alias(c) for c in columns]
    )


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` (all columns), each as often as the mix takes it; a copy taken in part is kept whole.

    The mix is decided on ids and sizes; how often each id and text is taken is then joined to the rows, so the text
    moves once. Of rows that repeat an id and text each gets its even share, and the remainder goes to one of them.
    """
    mark = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    narrow = docs.select("doc_id", "text", "source", mark.alias("mark"))
    found = fair_mix(narrow, weights, epochs, seed, columns=("mark",))
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.sum(times).alias("_times"), F.count("*").alias("_rows"))
    found = write_once(found.filter("_times > 0"))
    mine = docs["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (mark == F.col("_mark"))
    joined = docs.join(found.hint("merge"), mine)  # as many rows as documents, so never a broadcast
    out = joined.withColumn("_each", F.floor(F.col("_times") / F.col("_rows")).cast("int")).filter("_each > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_each")))).select(*docs.columns)
    if found.filter("_times % _rows > 0").isEmpty():
        return out
    rest = joined.filter("_times % _rows > 0").dropDuplicates(["_id", "_mark"])
    rest = rest.withColumn("_copy", F.explode(F.sequence(F.lit(1), (F.col("_times") % F.col("_rows")).cast("int"))))
    return out.unionByName(rest.select(*docs.columns))
