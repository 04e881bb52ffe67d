"""Line dedup by a fixed-depth log-template tree, in DataFrame functions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import texts, write_once

LEAD = 3
LEAST_TOKENS = 3
SEGMENTS = 8
ALIKE = 0.7
#: Lines with fewer places behind the leading tokens must agree in all of them.
LEAST_PLACES = 4
MIN_TEXTS = 2

#: A token with a digit is a variable field. The look-behind and the possessive run keep long tokens linear.
FIELD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
BLANK = r"[\x20\x09-\x0D]+"
MASK = "<*>"


def _tokens(line: Column) -> Column:
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, FIELD, MASK)).otherwise(line)
    return F.array_remove(F.split(masked, BLANK), "")


def _mark(text: Column) -> Column:
    return F.xxhash64(text)


def parsed_lines(own: DataFrame) -> DataFrame:
    """``doc_id, body, at, leaf, sig, size, parts`` of each line with ``LEAST_TOKENS`` tokens: a hash of the text, the place of
    the line, the leaf of the tree it falls to, named by token count and leading tokens, a hash of the masked line, the number of its
    tokens behind the leading ones and the hashes of ``SEGMENTS`` equal stretches of those (of single tokens in short lines)."""
    lines = own.select("doc_id", _mark(F.col("text")).alias("body"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    found = lines.select("doc_id", "body", "at", _tokens(F.col("line")).alias("tokens"))
    found = found.filter(F.size("tokens") >= LEAST_TOKENS).withColumn("size", F.greatest(F.size("tokens") - LEAD, F.lit(0)))
    edges = [F.floor(F.col("size") * k / SEGMENTS).cast("int") for k in range(SEGMENTS + 1)]
    parts = F.array(*[F.hash(F.slice("tokens", lo + LEAD + 1, hi - lo)) for lo, hi in zip(edges, edges[1:])])
    leaf = F.xxhash64(F.size("tokens"), F.slice("tokens", 1, LEAD))
    return found.select("doc_id", "body", "at", leaf.alias("leaf"), F.xxhash64("tokens").alias("sig"), "size", parts.alias("parts"))


def templates(spread: DataFrame) -> DataFrame:
    """``leaf, sig, template`` of masked lines, from ``leaf, sig, texts, first, size, parts``.

    In each leaf the masked line found in the most texts (of equals the one that occurs first) gives the template, and lines
    that agree with it in at least ``ALIKE`` of their stretches differ from it in variable fields only; the others are
    their own template. So are lines of fewer than ``LEAST_PLACES`` places behind the leading tokens, which the leaf makes equal.
    """
    best = F.min_by(F.struct(F.col("sig").alias("template"), F.col("parts").alias("anchor")), F.struct((-F.col("texts")).alias("n"), "first"))
    anchors = spread.groupBy("leaf").agg(best.alias("best")).select(F.col("leaf").alias("_leaf"), "best.template", "best.anchor")
    same = sum(F.when(F.get("parts", F.lit(k)) == F.get("anchor", F.lit(k)), 1).otherwise(0) for k in range(SEGMENTS))
    full = F.least(F.col("size"), F.lit(SEGMENTS))  # empty stretches of short lines always agree
    alike = (same - (SEGMENTS - full) >= ALIKE * full) & (F.col("size") >= LEAST_PLACES)
    joined = spread.join(anchors, F.col("leaf") == F.col("_leaf"))
    return joined.select(F.col("leaf").alias("_leaf"), F.col("sig").alias("_sig"), F.when(alike, F.col("template")).otherwise(F.col("sig")).alias("template"))


def _loose(full: int) -> int:
    """How many of ``full`` stretches may differ in lines that agree in ``ALIKE`` of them; none of fewer than ``LEAST_PLACES``."""
    return 0 if full < LEAST_PLACES else next(n for n in range(full, -1, -1) if full - n >= ALIKE * full)


def _forms(groups_of) -> Column:
    """A hash for each group of stretches that ``groups_of(number of stretches that may differ)`` names, with the leaf."""

    def hashes(loose: int) -> Column:
        kept = [F.xxhash64("leaf", F.lit(k), *[F.get("parts", F.lit(j)) for j in group]) for k, group in enumerate(groups_of(loose))]
        return F.array(*kept)

    chosen = hashes(_loose(SEGMENTS))
    for full in range(SEGMENTS - 1, 0, -1):
        if _loose(full) != _loose(full + 1):
            chosen = F.when(F.col("size") <= full, hashes(_loose(full))).otherwise(chosen)
    return chosen


def later_alike(kept: DataFrame, min_texts: int) -> DataFrame:
    """``leaf, sig, body`` of those of ``kept`` (``leaf, sig, body, none, doc_id, size, parts``) that share a form with a
    text that comes first. A form is a leaf and all stretches but as many as may differ, so lines share one exactly if they
    agree in ``ALIKE`` of their stretches.

    Of stretches dealt into one group more than may differ one group is equal as a whole; lines without such a group in
    another text are put aside by a minimum and maximum per group, before each is a row per form.
    """
    groups = _forms(lambda loose: [range(SEGMENTS)[k :: loose + 1] for k in range(loose + 1)])
    grouped = kept.select("leaf", "sig", "body", F.explode(groups).alias("form"))
    shared = grouped.groupBy("form").agg(F.min("body").alias("a"), F.max("body").alias("b")).filter("a <> b").select(F.col("form").alias("_form"))
    near = grouped.join(shared.hint("merge"), F.col("form") == F.col("_form"))
    near = near.select(F.col("leaf").alias("_leaf"), F.col("sig").alias("_sig"), F.col("body").alias("_body")).distinct()
    same = (F.col("leaf") == F.col("_leaf")) & (F.col("sig") == F.col("_sig")) & (F.col("body") == F.col("_body"))
    forms = _forms(lambda loose: list(combinations(range(SEGMENTS), SEGMENTS - loose)))
    formed = write_once(kept.join(near.hint("merge"), same).select("leaf", "sig", "body", "none", "doc_id", F.explode(forms).alias("form")))
    by_text = formed.groupBy("form", "body").agg(F.min(F.struct("none", "doc_id")).alias("least"))
    keeper = F.min_by("body", F.struct("least", "body")).alias("keeper")
    recurring = by_text.groupBy(F.col("form").alias("_form")).agg(F.count("*").alias("n"), keeper).filter(F.col("n") >= min_texts)
    later = formed.join(recurring.hint("merge"), F.col("form") == F.col("_form")).filter(F.col("body") != F.col("keeper"))
    return later.select("leaf", "sig", "body").distinct()


def line_dedup(docs: DataFrame, min_texts: int = MIN_TEXTS, columns: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` per document: its text without the lines of recurring templates; ``columns`` are
    carried along.

    Lines end at ``\\n``. A line is parsed into tokens (runs without ASCII white space), those with a digit masked; it
    falls to the leaf of its token count and first ``LEAD`` tokens and takes the leaf's template where it agrees with it in
    ``ALIKE`` of the stretches behind those tokens (in all of fewer than ``LEAST_PLACES``), else its own masked form. A template recurs if lines of at least ``min_texts`` different texts
    take it; the text whose least id comes first keeps such lines and all others drop them. Lines that are left and agree
    with each other, but not with their leaf's template, are templates of their own by ``later_alike``, with the same rule.
    Lines of fewer than ``LEAST_TOKENS`` tokens are kept.

    Null texts count as empty; equal texts are one text, so copies of the keeper keep their lines too; a document of
    which nothing is left has an empty text; null ids come last (of texts with the same least id the first by hash keeps);
    repeated rows are treated alike; an empty table gives no rows.

    The text is parsed once. Lines of leaves that only one text reaches are put aside first, by a minimum and maximum per leaf;
    what is left is counted per text before it is counted per line, so a line that a third of all rows share is a
    row per task. The text is shuffled once, for its dropped lines, whatever the size of the table.
    """
    lines = write_once(parsed_lines(texts(docs)))
    reached = lines.groupBy("leaf").agg(F.min("body").alias("a"), F.max("body").alias("b")).filter("a <> b")
    met = lines.join(reached.select(F.col("leaf").alias("_leaf")).hint("merge"), F.col("leaf") == F.col("_leaf")).drop("_leaf")
    met = write_once(met)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")
    firsts = [F.min(place).alias("first"), F.first("size").alias("size"), F.first("parts").alias("parts")]
    per_text = write_once(met.groupBy("leaf", "sig", "body").agg(*firsts))
    spread = per_text.groupBy("leaf", "sig").agg(F.count("*").alias("texts"), F.min("first").alias("first"), F.first("size").alias("size"), F.first("parts").alias("parts"))
    found = write_once(templates(spread))
    takes = (F.col("leaf") == F.col("_leaf")) & (F.col("sig") == F.col("_sig"))
    by_text = per_text.join(found.hint("merge"), takes).groupBy("leaf", "template", "body").agg(F.min("first").alias("first"))
    keeper = F.min_by("body", F.struct("first.none", "first.doc_id", "body")).alias("keeper")
    recurring = by_text.groupBy("leaf", "template").agg(F.count("*").alias("n"), keeper).filter(F.col("n") >= min_texts)
    recurring = recurring.select(F.col("leaf").alias("_of"), F.col("template").alias("_template"), "keeper")
    judged = found.join(recurring, (F.col("_leaf") == F.col("_of")) & (F.col("template") == F.col("_template")))
    judged = write_once(judged.select("_leaf", "_sig", "keeper"))
    gone = takes & (F.col("body") != F.col("keeper"))
    kept = per_text.join(judged.hint("merge"), gone, "left_anti").select("leaf", "sig", "body", "first.none", "first.doc_id", "size", "parts")
    later = later_alike(write_once(kept), min_texts).select(F.col("leaf").alias("_leaf"), F.col("sig").alias("_sig"), F.col("body").alias("_text"))
    dropped = met.join(judged.hint("merge"), gone).select("body", "at")
    dropped = dropped.unionByName(met.join(later.hint("merge"), takes & (F.col("body") == F.col("_text"))).select("body", "at"))
    dropped = write_once(dropped.groupBy(F.col("body").alias("_body")).agg(F.collect_set("at").alias("dropped")))
    carried = F.struct(*[docs[c] for c in columns] or [F.lit(0).alias("none")]).alias("carried")
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), carried)
    lined = own.withColumn("body", _mark(F.col("text"))).join(dropped.hint("merge"), F.col("body") == F.col("_body"), "left")
    split = F.split("text", "\n")
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("dropped")))
    cleaned = F.array_join(F.transform(kept, lambda k: F.element_at(split, k + 1)), "\n")
    return lined.select(
        "doc_id",
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(cleaned).alias("text"),
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        *[F.col(f"carried.{c}").alias(c) for c in columns],
    )




def _sql_groups() -> str:
    """For each number of places the choices of stretches that must agree, as SQL lists."""
    def lists(loose: int) -> str:
        return "[" + ", ".join(str([k + 1 for k in c]) for c in combinations(range(SEGMENTS), SEGMENTS - loose)) + "]"

    cases = " ".join(f"WHEN places <= {full} THEN {lists(_loose(full))}" for full in range(1, SEGMENTS))
    return f"CASE {cases} ELSE {lists(_loose(SEGMENTS))} END"


_NONE = 9223372036854775807
#: The same in DuckDB SQL, over the table ``documents``.
SQL = rf"""
WITH own AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT text, min(doc_id) AS doc_id, string_split(text, chr(10)) AS parts FROM own GROUP BY text),
lines AS (SELECT text, doc_id, unnest(range(1, len(parts) + 1)) AS pos, unnest(parts) AS line FROM cut),
parsed AS (
  SELECT text, doc_id, pos, [x FOR x IN string_split_regex(
           regexp_replace(' ' || line, '([ \t\n\v\f\r])[^ \t\n\v\f\r0-9]*[0-9][^ \t\n\v\f\r]*', '\1{MASK}', 'g'), '[ \t\n\v\f\r]+')
         IF x <> ''] AS tokens
  FROM lines),
kept AS (
  SELECT text, coalesce(doc_id, {_NONE}) AS doc_id, pos, array_to_string(tokens, ' ') AS sig, len(tokens) AS n, tokens[1:{LEAD}] AS head,
         len(tokens) - {LEAD} AS places, tokens[{LEAD + 1}:] AS rest
  FROM parsed WHERE len(tokens) >= {LEAST_TOKENS}),
spread AS (
  SELECT n, head, sig, places, any_value([array_to_string(rest[(i * places // {SEGMENTS}) + 1 : (i + 1) * places // {SEGMENTS}], ' ')
           FOR i IN range({SEGMENTS})]) AS parts, count(DISTINCT text) AS texts, min(doc_id) AS first_id, arg_min(pos, (doc_id, pos)) AS first_pos
  FROM kept GROUP BY n, head, sig, places),
anchors AS (SELECT n, head, sig AS template, parts AS anchor FROM spread
            QUALIFY row_number() OVER (PARTITION BY n, head ORDER BY texts DESC, first_id, first_pos, sig) = 1),
alike AS (SELECT s.sig, a.template FROM spread s JOIN anchors a ON s.n = a.n AND s.head = a.head
          WHERE s.places >= {LEAST_PLACES} AND list_sum([(s.parts[i] = a.anchor[i])::INT FOR i IN range(1, {SEGMENTS} + 1)])
            - ({SEGMENTS} - least(s.places, {SEGMENTS})) >= {ALIKE} * least(s.places, {SEGMENTS})),
taken AS (SELECT k.text, k.pos, k.doc_id, k.sig, coalesce(a.template, k.sig) AS template FROM kept k LEFT JOIN alike a ON k.sig = a.sig),
by_text AS (SELECT DISTINCT template, text, doc_id FROM taken),
recurring AS (SELECT template, arg_min(text, (doc_id, text)) AS keeper FROM by_text GROUP BY template HAVING count(*) >= {MIN_TEXTS}),
first_gone AS (SELECT t.text, t.pos FROM taken t JOIN recurring r ON t.template = r.template WHERE t.text <> r.keeper),
left_over AS (SELECT DISTINCT t.text, t.doc_id, t.sig FROM taken t ANTI JOIN first_gone g ON t.text = g.text AND t.pos = g.pos),
formed AS (
  SELECT text, doc_id, sig, n, head, g, [parts[i] FOR i IN g] AS form
  FROM (SELECT l.*, s.n, s.head, s.parts, unnest({_sql_groups()}) AS g FROM left_over l JOIN spread s ON l.sig = s.sig)),
form_keepers AS (SELECT n, head, g, form, arg_min(text, (doc_id, text)) AS keeper FROM formed GROUP BY ALL HAVING count(DISTINCT text) >= {MIN_TEXTS}),
later AS (SELECT DISTINCT f.text, f.sig FROM formed f JOIN form_keepers k ON f.n = k.n AND f.head = k.head AND f.g = k.g AND f.form = k.form WHERE f.text <> k.keeper),
dropped AS (SELECT text, pos FROM first_gone UNION SELECT t.text, t.pos FROM taken t JOIN later l ON t.text = l.text AND t.sig = l.sig),
gone AS (SELECT text, list(pos) AS dropped FROM dropped GROUP BY text)
SELECT o.doc_id,
       CASE WHEN g.dropped IS NULL THEN o.text ELSE array_to_string([c.parts[i] FOR i IN range(1, len(c.parts) + 1)
         IF NOT list_contains(g.dropped, i)], chr(10)) END AS text,
       len(c.parts)::BIGINT AS n_lines, coalesce(len(g.dropped), 0)::BIGINT AS n_dropped
FROM own o JOIN cut c ON o.text = c.text LEFT JOIN gone g ON o.text = g.text"""
