"""Secret scan by linking the parts of credentials, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts, write_once

#: Parts of a credential whose starts are at most this many code points apart belong together, within one paragraph.
REACH = 400
#: In the order of ``spans``: the first three stand alone, the others are weak and count only beside a complement.
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint", "opaque")
STRONG = KINDS[:3]
#: For each weak kind the kinds that complete it.
COMPLEMENTS = {
    "id": ("assign", "secret", "opaque"),
    "secret": ("access", "id", "endpoint"),
    "endpoint": ("assign", "secret"),
    "opaque": ("access", "id"),
}
BREAK = "break"


def _any_case(*labels: str) -> str:
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in label) for label in labels)


_SET = r"""["']?\x20*[:=]\x20*["']?"""
#: The patterns of the strong kinds.
ASSIGN = f"({_any_case('password', 'passwd', 'secret', 'token', 'api_?key')}){_SET}([A-Za-z0-9+/_.=-]+)"
ACCESS, HEX = "AKIA[A-Z0-9]+", "[0-9a-f]{32,}"
ASSIGN_LEAST, ACCESS_LEAST, SHORT_LEAST, OPAQUE_SIZE = 8, 16, 4, 40
#: Labelled names, labelled secrets that the strong pattern does not name, places to connect to, and unlabelled tokens.
IDS = f"({_any_case('access_?key_?id', 'client[_-]?id', 'app_?id', 'account_?id', 'key_?id', 'tenant_?id', 'user_?id', 'user_?name', 'login')}){_SET}([A-Za-z0-9._@-]+)"
SECRETS = f"({_any_case('passphrase', 'pwd', 'private_?key', 'access_?key', 'secret_?key', 'auth_?key', 'credential')}){_SET}([A-Za-z0-9+/_.=-]+)"
ENDPOINTS = f"[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._~:@/?=&%+-]+|({_any_case('hostname', 'host', 'endpoint', 'server')}){_SET}([A-Za-z0-9.:-]+)"
OPAQUE = "[A-Za-z0-9+/]{40,}"
PARAGRAPH = r"\n[\x20\x09\x0D]*\n"
#: Words of which a text must contain one (in lower case) before the pattern of the kind is tried.
HINTS = {
    "assign": ("passw", "secret", "token", "apikey", "api_key"),
    "id": ("id", "username", "user_name", "login"),
    "secret": ("passphrase", "pwd", "privatekey", "private_key", "access", "secret", "auth", "credential"),
    "endpoint": ("://", "host", "endpoint", "server"),
}


def _hits(text: Column, name: str, pattern: str, kind, value_group: int = 0) -> Column:
    """``pattern, at, gap, kind, found`` of each leftmost match: the name of its pattern, its number, the code points between it and the match before,
    and what ``kind(match, value)`` makes of it (null: nothing)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    zipped = F.arrays_zip(F.split(text, pattern, -1), found, value).cast("array<struct<before:string,found:string,value:string>>")
    hits = F.transform(
        F.filter(zipped, lambda z: z["found"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(name).alias("pattern"), i.alias("at"), F.char_length(z["before"]).alias("gap"), kind(z["found"], z["value"]).alias("kind"), z["found"].alias("found")
        ),
    )
    return hits


_NONE = "array<struct<pattern:string,at:int,gap:int,kind:string,found:string>>"


def _where(test: Column, hits: Column) -> Column:
    return F.when(test, hits).otherwise(F.array().cast(_NONE))


def _named(kind: str, least: int = 1):
    return lambda found, value: F.when(F.char_length(value) >= least, F.lit(kind))


def _assigned(found: Column, value: Column) -> Column:
    size = F.char_length(value)
    return F.when(size >= ASSIGN_LEAST, F.lit("assign")).when(size >= SHORT_LEAST, F.lit("secret"))


def _opaque(found: Column, value: Column) -> Column:
    mixed = found.rlike("[A-Z]") & found.rlike("[a-z]") & found.rlike("[0-9]")
    return F.when((F.char_length(found) == OPAQUE_SIZE) & mixed, F.lit("opaque"))


def _hits_of_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, key, weak, hits`` per document; the key is a digest of the text, null where nothing matches, and ``weak``
    says that the text holds candidates which need a complement."""
    text = F.col("text")

    def hinted(kind: str) -> Column:
        any_of = F.lit(False)
        for word in HINTS[kind]:
            any_of = any_of | F.col("lower").contains(word)
        return any_of

    own = texts(docs).withColumn("lower", F.lower("text"))
    own = own.select(
        "doc_id",
        "text",
        _where(hinted("assign"), _hits(text, "assign", ASSIGN, _assigned, 2)).alias("assign"),
        _where(text.contains("AKIA"), _hits(text, "access", ACCESS, _named("access", ACCESS_LEAST))).alias("access"),
        _where(text.rlike(HEX), _hits(text, "hex", HEX, _named("hex"))).alias("hex"),
        _where(hinted("id"), _hits(text, "id", IDS, _named("id", SHORT_LEAST), 2)).alias("id"),
        _where(hinted("secret"), _hits(text, "secret", SECRETS, _named("secret", SHORT_LEAST), 2)).alias("secret"),
    )
    named = (F.size("id") > 0) | (F.size("access") > 0)
    opaque = _where(named, _hits(text, "opaque", OPAQUE, _opaque))
    closed = (F.size("assign") > 0) | (F.size("secret") > 0)  # an endpoint alone is no credential
    endpoint = _where(closed & (text.contains("://") | F.lower(text).rlike("host|endpoint|server")), _hits(text, "endpoint", ENDPOINTS, _named("endpoint")))
    own = own.withColumns({"opaque": opaque, "endpoint": endpoint})
    short = F.exists("assign", lambda h: h["kind"] == "secret")
    weak = short | (F.size("id") > 0) | (F.size("secret") > 0) | (F.size("opaque") > 0) | (F.size("endpoint") > 0)
    own = own.withColumn("weak", weak)
    breaks = _where(F.col("weak"), _hits(text, BREAK, PARAGRAPH, _named(BREAK)))
    hits = F.concat("assign", "access", "hex", "id", "secret", "endpoint", "opaque", breaks)
    any_hit = F.col("weak") | (F.size("assign") > 0) | (F.size("access") > 0) | (F.size("hex") > 0)
    return own.select("doc_id", F.when(any_hit, F.sha2("text", 256)).alias("key"), "weak", hits.alias("hits"))


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind)


def _located(hits: DataFrame) -> DataFrame:
    """``key, weak, kind, start, end, found`` of the parts (and paragraph breaks) of each different text."""
    each = hits.filter("key IS NOT NULL").select("key", "weak", F.explode("hits").alias("h")).select("key", "weak", "h.*")
    once = each.groupBy("key", "pattern", "at").agg(*[F.first(c).alias(c) for c in ("weak", "gap", "kind", "found")])
    size = F.char_length("found")
    upto = Window.partitionBy("key", "pattern").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum((F.col("gap") + size).cast("long")).over(upto)
    return once.withColumn("end", end).filter("kind IS NOT NULL").select("key", "weak", "kind", (F.col("end") - size).alias("start"), "end", "found")


def _linked(parts: DataFrame) -> DataFrame:
    """The weak ones of ``parts`` that have a complement in their paragraph, their starts at most ``REACH`` apart.

    A part meets others of its text, paragraph and stretch of ``REACH`` code points (or the next), so a part joins with
    as many as fit into three stretches, however long a text is. A labelled weak part that overlaps a strong one is left
    out, an unlabelled one that overlaps any other too; both still complete others.
    """
    order = Window.partitionBy("key").orderBy("start", _rank(F.col("kind")))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    strong, firm = F.col("kind").isin(*STRONG), ~F.col("kind").isin(BREAK, "opaque")

    def covered(by: Column) -> Column:
        ends = F.max(F.when(by, F.col("end"))).over(before) > F.col("start")
        return F.coalesce(ends, F.lit(False)) | F.coalesce(F.min(F.when(by, F.col("start"))).over(after) < F.col("end"), F.lit(False))

    placed = parts.filter("weak").withColumns(
        {
            "scope": F.sum(F.when(F.col("kind") == BREAK, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "covered": F.when(F.col("kind") == "opaque", covered(firm)).otherwise(covered(strong)),
            "bin": F.floor(F.col("start") / REACH),
        }
    )
    placed = write_once(placed.filter(F.col("kind") != BREAK))
    asked = placed.filter(~F.col("kind").isin(*STRONG) & ~F.col("covered")).alias("w")
    near = F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin")
    others = placed.select("key", "scope", F.col("kind").alias("other"), F.col("start").alias("other_start"), near).alias("o")
    meets = [F.col(f"w.{c}") == F.col(f"o.{c}") for c in ("key", "scope", "bin")]
    completes = F.lit(False)
    for kind, wanted in COMPLEMENTS.items():
        completes = completes | ((F.col("kind") == kind) & F.col("other").isin(*wanted))
    close = F.abs(F.col("start") - F.col("other_start")) <= REACH
    return asked.join(others.hint("merge"), [*meets, close, completes], "left_semi").select("key", "kind", "start", "end", "found")


def find_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, secrets`` per document, ``secrets`` being an array of ``start, rank, end, kind, found`` ordered by start and kind;
    starts and ends in code points, the end excluded.

    Strong parts (assigned secrets of eight characters, access identifiers, long hexadecimal runs) are always reported. Weak
    parts (labelled identifiers, short or otherwise labelled secrets, endpoints, unlabelled tokens of forty characters)
    are reported only if one of their ``COMPLEMENTS`` starts within ``REACH`` code points in the same paragraph.

    Whole texts are scanned once and not shuffled; a null text counts as empty and has none. Equal texts are one text
    after the scan, so copies add nothing to a task but their narrow rows; repeated rows, null ids and ids given twice each
    get their own row; an empty table gives no rows.
    """
    hits = write_once(_hits_of_texts(docs))
    parts = write_once(_located(hits))
    found = parts.filter(F.col("kind").isin(*STRONG)).select("key", "kind", "start", "end", "found").unionByName(_linked(parts))
    entry = F.struct("start", _rank(F.col("kind")).cast("int").alias("rank"), "end", "kind", "found")
    per_text = found.groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_list(entry)).alias("secrets"))
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,found:string>>")
    quiet = hits.filter("key IS NULL").select("doc_id", none.alias("secrets"))
    joined = hits.filter("key IS NOT NULL").select("doc_id", "key").join(per_text.hint("merge"), F.col("key") == F.col("_key"), "left")
    return quiet.unionByName(joined.select("doc_id", F.coalesce("secrets", none).alias("secrets")))


def secret_digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of ``find_secrets``: spans are ``kind:start:end`` joined by commas."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["rank"] <= len(STRONG))
    return find_secrets(docs).select("doc_id", *[count(k) for k in STRONG], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_hits(name: str, pattern: str, group: int, kind: str) -> str:
    p = _quoted(pattern)
    return f"""SELECT r, {kind} AS kind, found, upto - length(found) AS s, upto AS e FROM (
    SELECT r, found, value, sum(length(gap) + length(found)) OVER (PARTITION BY r ORDER BY i) AS upto FROM (
      SELECT r, unnest(range(len(m))) AS i, unnest(m) AS found, unnest(v) AS value, unnest(g[1:len(m)]) AS gap FROM (
        SELECT r, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS v, string_split_regex(text, {p}) AS g FROM own) AS {name}_m))"""


_RANKS = "list_position([" + ", ".join(f"'{k}'" for k in KINDS) + "], kind)"
_SPAN = "kind || ':' || s || ':' || e"
#: The same in DuckDB SQL, over the table ``documents``.
SQL = f"""
WITH own AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
hits AS (
  {_sql_hits("a", ASSIGN, 2, f"CASE WHEN length(value) >= {ASSIGN_LEAST} THEN 'assign' WHEN length(value) >= {SHORT_LEAST} THEN 'secret' END")}
  UNION ALL {_sql_hits("b", ACCESS, 0, f"CASE WHEN length(found) >= {ACCESS_LEAST} THEN 'access' END")}
  UNION ALL {_sql_hits("c", HEX, 0, "'hex'")}
  UNION ALL {_sql_hits("d", IDS, 2, f"CASE WHEN length(value) >= {SHORT_LEAST} THEN 'id' END")}
  UNION ALL {_sql_hits("e", SECRETS, 2, f"CASE WHEN length(value) >= {SHORT_LEAST} THEN 'secret' END")}
  UNION ALL {_sql_hits("f", ENDPOINTS, 0, "'endpoint'")}
  UNION ALL {_sql_hits("g", OPAQUE, 0, f"CASE WHEN length(found) = {OPAQUE_SIZE} AND regexp_matches(found, '[A-Z]') AND regexp_matches(found, '[a-z]') AND regexp_matches(found, '[0-9]') THEN 'opaque' END")}
  UNION ALL {_sql_hits("h", PARAGRAPH, 0, f"'{BREAK}'")}),
parts AS (SELECT *, {_RANKS} AS k, count(*) FILTER (kind = '{BREAK}') OVER (PARTITION BY r ORDER BY s) AS scope FROM hits WHERE kind IS NOT NULL),
strong AS (SELECT * FROM parts WHERE k <= {len(STRONG)}),
weak AS (SELECT * FROM parts w WHERE k > {len(STRONG)}
  AND NOT EXISTS (SELECT 1 FROM parts o WHERE o.r = w.r AND o.s < w.e AND w.s < o.e AND (o.k <= {len(STRONG)} OR (w.kind = 'opaque' AND o.k < w.k)))),
linked AS (SELECT * FROM weak w WHERE EXISTS (SELECT 1 FROM parts o WHERE o.r = w.r AND o.scope = w.scope AND abs(o.s - w.s) <= {REACH}
  AND ({" OR ".join(f"(w.kind = '{k}' AND o.kind IN ({', '.join(repr(c) for c in of)}))" for k, of in COMPLEMENTS.items())}))),
of_text AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg({_SPAN}, ',' ORDER BY s, k) FILTER (k <= {len(STRONG)}) AS base, string_agg({_SPAN}, ',' ORDER BY s, k) AS spans
  FROM (SELECT r, kind, k, s, e FROM strong UNION ALL SELECT r, kind, k, s, e FROM linked) GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM own LEFT JOIN of_text USING (r)"""
