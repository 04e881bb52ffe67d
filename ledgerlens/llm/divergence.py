"""Audit of how far sources diverge from their language and from each other, term strings joined back last."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import write_once

MIN_DOCS = 3
SCALE = 1_000_000_000
TOP = 200
SLICE_BYTES = 4 << 20

#: Bytes between terms: ASCII but its letters.
_GAP = np.ones(256, bool)
_GAP[128:] = False
_GAP[[*range(65, 91), *range(97, 123)]] = False


def _slice_terms(raw: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(terms, digests, begins, group, occurrences, documents)``: the different terms, a digest of 64 bits of each, and for each its groups of
    texts one after another, beginning at ``begins``. Terms are told apart by their bytes."""
    starts, ends, firsts = words.bounds(raw, offsets, _GAP)
    codes, terms, digests = words.distinct_words(raw, starts, ends, _GAP)
    named, group = np.unique(groups, return_inverse=True)
    texts, n = np.unique(codes.astype(np.int64) * (len(offsets) - 1) + np.repeat(np.arange(len(offsets) - 1), np.diff(firsts)), return_counts=True)
    code, text = np.divmod(texts, len(offsets) - 1)
    kinds, kind = np.unique(code * len(named) + group[text], return_inverse=True)
    code, group = np.divmod(kinds, len(named))
    begins = np.searchsorted(code, np.arange(len(terms) + 1))
    return terms, digests, begins, named[group], np.bincount(kind, n).astype(np.int64), np.bincount(kind).astype(np.int64)


def slice_terms(own: DataFrame, digest_bits: int = 64) -> DataFrame:
    """``digest, term, groups, n, docs`` of each different term of each stretch of texts that a task reads at a time, the last three being arrays with
    an element per group; ``own`` has ``grp, text``. Fewer ``digest_bits`` make digests collide, as a test of how collisions are split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in words.slices(batch.column("text"), SLICE_BYTES):
                groups = batch.column("grp").slice(first, len(offsets) - 1).to_numpy()
                terms, digests, begins, *lists = _slice_terms(raw, offsets, groups)
                begins = pa.array(begins, pa.int32())
                columns = [pa.array((digests >> np.uint64(64 - digest_bits)).view(np.int64)), terms.cast(pa.string())]
                columns += [pa.ListArray.from_arrays(begins, pa.array(x)) for x in lists]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "term", "groups", "n", "docs"])

    return own.select("grp", "text").mapInArrow(run, "digest long, term string, groups array<long>, n array<long>, docs array<long>")


def numbered_groups(own: DataFrame) -> tuple[DataFrame, int]:
    """``grp, lang_id, lang, source`` of every group, written, and the seed of the hash that gives the two ids. Seeds are tried until no two
    groups or languages share an id."""
    named = write_once(own.select("lang", "source").distinct())
    seed = 0
    while True:
        groups = named.select(_group_id(seed).alias("grp"), F.xxhash64(F.lit(seed), "lang").alias("lang_id"), "lang", "source")
        met = groups.agg(F.count("*"), F.count_distinct("grp"), F.count_distinct("lang_id"), F.count_distinct("lang")).first()
        if met[0] == met[1] and met[2] == met[3]:
            return write_once(groups), seed
        seed += 1


def _group_id(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "lang", "source")


def _number(c: Column | int) -> Column:
    return (F.lit(c) if isinstance(c, int) else c).cast("decimal(20,0)")


def _share(count: Column, total: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / total)``, exact for any counts of 64 bits."""
    over = F.call_function("div", _number(SCALE) * _number(count + 1), total.cast("decimal(20,0)"))
    return (over + 1).cast("long")


def _gap_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def kept_counts(own: DataFrame, groups: DataFrame, seed: int, min_docs: int = MIN_DOCS, digest_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(counts, dictionary)``: ``lang_id, grp, digest, split, n, lang_n`` of the terms that a language keeps, and
    ``digest, split, term``.

    What is shuffled for the counts is digests and group ids, 8 bytes wide each. The strings of a digest are reduced to their minimum
    and maximum, in a pass that sees neither sources nor counts; where the two differ, several terms share the digest, and those
    are counted again by string, ``split`` being the string (empty for all other digests).
    """
    slices = write_once(slice_terms(own.withColumn("grp", _group_id(seed)), digest_bits))
    both = write_once(slices.groupBy("digest").agg(F.min("term").alias("low"), F.max("term").alias("high")))
    shared = both.filter("low <> high").select(F.col("digest").alias("_digest"))
    each = F.inline(F.arrays_zip(F.col("groups").alias("grp"), "n", "docs")).alias("grp", "n", "docs")
    sums = [F.sum("n").alias("n"), F.sum("docs").alias("docs")]
    counted = slices.select("digest", each).groupBy("grp", "digest").agg(*sums).withColumn("split", F.lit(""))
    dictionary = both.select("digest", F.lit("").alias("split"), F.col("low").alias("term"))
    if not shared.isEmpty():
        together = F.col("digest") == F.col("_digest")
        again = slices.join(shared, together, "left_semi").select("digest", "term", each).groupBy("grp", "digest", F.col("term").alias("split"))
        again = again.agg(*sums).select(counted.columns)
        counted = counted.join(shared, together, "left_anti").unionByName(again)
        spelled = again.select("digest", "split", F.col("split").alias("term")).distinct()
        dictionary = both.filter("low = high").select("digest", F.lit("").alias("split"), F.col("low").alias("term")).unionByName(spelled)
    counted = write_once(counted.join(groups.select("grp", "lang_id"), "grp"))
    of_lang = counted.groupBy("lang_id", "digest", "split").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    of_lang = of_lang.filter(F.col("docs") >= min_docs).drop("docs")
    return counted.drop("docs").join(of_lang, ["lang_id", "digest", "split"]), dictionary


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, digest_bits: int = 64) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source of a language differs from the other sources (``pair``) and in
    which terms it exceeds its language most (``term``, the first ``top``).

    A language keeps the terms (runs of letters and non-ASCII characters, A-Z lower-cased) found in at least ``min_docs``
    of its documents. A group gives each kept term the share ``p = 1 + floor(SCALE * (count + 1) / (N + V))``, zero counts
    included; the difference of two shares is ``floor((p - q) ** 2 / q)``, whole numbers throughout.

    A pair's sum over all terms needs only the terms that both sources have: what a source's terms add against a source
    without them depends on their count alone, so it is summed over the few different counts of a group. Terms of a
    source are therefore a histogram of counts but for those it shares. The term part takes, per group, the values
    down to the ``top``-th before strings are joined to it, ties included, and ranks after the join.

    Null texts, languages and sources count as empty; a language without kept terms gives pairs of value 0; repeated
    rows count as often as they occur; an empty table gives no rows.
    """
    own = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    groups, seed = numbered_groups(own)
    counts, dictionary = kept_counts(own, groups, seed, min_docs, digest_bits)
    counts = write_once(counts)
    sizes = counts.groupBy("grp").agg(F.sum("n").alias("size"), F.count("*").alias("terms"))
    of_lang = counts.groupBy("lang_id", "digest", "split").agg(F.first("lang_n").alias("n")).groupBy("lang_id").agg(F.sum("n").alias("lang_size"), F.count("*").alias("kept"))
    sized = groups.select("grp", "lang_id").join(sizes, "grp", "left").join(of_lang, "lang_id", "left").fillna(0, ["size", "terms", "lang_size", "kept"])
    total = F.col("size") + F.col("kept")
    none = F.when(total > 0, _share(F.lit(0), F.greatest(total, F.lit(1)))).alias("none")
    sized = write_once(sized.select("grp", "lang_id", "terms", "kept", total.alias("total"), (F.col("lang_size") + F.col("kept")).alias("lang_total"), none))
    shares = counts.join(sized.select("grp", "total", "lang_total", "none"), "grp")
    p, q = _share(F.col("n"), F.col("total")), _share(F.col("lang_n"), F.col("lang_total"))
    shares = write_once(shares.select("lang_id", "grp", "digest", "split", p.alias("p"), q.alias("q"), "none"))
    names = groups.select("grp", "lang", "source")
    pairs = _pairs(shares, sized).join(names.select(F.col("grp").alias("other"), F.col("source").alias("item")), "other")
    parts = _ranked(pairs.join(names, "grp").withColumn("part", F.lit("pair")))
    terms = _top_terms(shares, top).join(dictionary.withColumnRenamed("term", "item").hint("merge"), ["digest", "split"])
    return parts.unionByName(_ranked(terms.join(names, "grp").withColumn("part", F.lit("term"))).filter(F.col("rank") <= top))


def _ranked(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return df.select("lang", "source", "part", "item", "value", F.row_number().over(order).alias("rank"))


def _pairs(shares: DataFrame, sized: DataFrame) -> DataFrame:
    """``grp, other, value``: the sums for all pairs of sources of a language."""
    bases = sized.select("lang_id", "grp", "terms", "kept", "none")
    others = bases.select("lang_id", F.col("grp").alias("other"), F.col("terms").alias("other_terms"), F.col("none").alias("other_none"))
    pairs = write_once(bases.join(others, "lang_id").filter("grp <> other"))  # as many rows as the result
    exact = "decimal(38,0)"
    p, q, p0, q0, m = (F.col(c) for c in ("p", "q", "none", "other_none", "m"))
    by_count = write_once(shares.groupBy("grp", "p").agg(F.count("*").alias("m")))
    own = by_count.join(pairs.select("grp", "other", "other_none"), "grp")
    own = own.groupBy("grp", "other").agg(F.sum((m * _gap_of(p, q0)).cast(exact)).alias("own"))
    theirs = by_count.select(F.col("grp").alias("other"), "p", "m").join(pairs.select("grp", "other", "none"), "other")
    theirs = theirs.groupBy("grp", "other").agg(F.sum((m * _gap_of(p0, p)).cast(exact)).alias("theirs"))
    mine = shares.select("lang_id", "digest", "split", "grp", "p", "none")
    yours = mine.select("lang_id", "digest", "split", F.col("grp").alias("other"), F.col("p").alias("q"), F.col("none").alias("other_none"))
    met = mine.join(yours, ["lang_id", "digest", "split"]).filter("grp <> other")
    more = _gap_of(p, q) - _gap_of(p, q0) - _gap_of(p0, q) + _gap_of(p0, q0)
    both = met.groupBy("grp", "other").agg(F.sum(more.cast(exact)).alias("both"))
    found = pairs
    for sums in (own, theirs, both):
        found = found.join(sums, ["grp", "other"], "left")
    rest = (F.col("kept") - F.col("terms") - F.col("other_terms")).cast(exact) * _gap_of(p0, q0).cast("decimal(19,0)")
    zero = F.lit(0).cast(exact)
    value = F.coalesce(rest, zero) + F.coalesce("own", zero) + F.coalesce("theirs", zero) + F.coalesce("both", zero)
    return found.select("grp", "other", value.cast("long").alias("value"))


def _top_terms(shares: DataFrame, top: int) -> DataFrame:
    """``grp, digest, split, value`` of the terms that can be among the ``top`` of their group: those down to the ``top``-th value, ties included."""
    above = shares.filter("p > q").select("grp", "digest", "split", _gap_of(F.col("p"), F.col("q")).alias("value"))
    levels = Window.partitionBy("grp").orderBy(F.desc("value"))
    many = above.groupBy("grp", "value").agg(F.count("*").alias("m"))
    many = many.withColumn("level", F.row_number().over(levels)).filter(F.col("level") <= top)
    upto = F.sum("m").over(levels.rowsBetween(Window.unboundedPreceding, -1))
    least = many.withColumn("before", F.coalesce(upto, F.lit(0))).filter(F.col("before") < top)
    least = least.groupBy("grp").agg(F.min("value").alias("least"))
    return above.join(least, "grp").filter("value >= least").drop("least")


_UP, _DOWN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The same in DuckDB SQL, over the table ``documents``.
SQL = rf"""
WITH own AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
groups AS (SELECT DISTINCT lang, source FROM own),
said AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{_UP}', '{_DOWN}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM own),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM said GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
counts AS (SELECT s.lang, s.source, s.term, count(*)::HUGEINT AS n FROM said s JOIN kept k ON s.lang = k.lang AND s.term = k.term GROUP BY s.lang, s.source, s.term),
vocab AS (SELECT lang, sum(n)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
sizes AS (SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS n FROM groups g),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + {SCALE}::HUGEINT * (coalesce(c.n, 0) + 1) // (g.n + v.v) AS p,
         1 + {SCALE}::HUGEINT * (k.n + 1) // (v.n + v.v) AS q
  FROM sizes g JOIN kept k ON g.lang = k.lang JOIN vocab v ON v.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM all_pairs
UNION ALL
SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM terms
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP}"""
