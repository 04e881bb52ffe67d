"""Language identification that fuses text likelihoods with declared language, address suffix and host priors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words
from .common import write_once

BUCKET_BITS = 16
TRAIN_ROWS = 1_000
SMOOTHING = 0.5
TEXT_WEIGHT = 0.2
DECLARED_TRUST = 0.9
SUFFIX_TRUST = 0.6
HOST_WEIGHT = 8.0
ACCEPT = 0.5
UNKNOWN = "und"

#: Languages that country suffixes of addresses speak for.
SUFFIXES = {
    "at": "de", "au": "en", "cl": "es", "co": "es", "de": "de", "es": "es", "fr": "fr", "ie": "en", "it": "it", "jp": "ja",
    "mx": "es", "nl": "nl", "nz": "en", "pl": "pl", "pt": "pt", "ru": "ru", "se": "sv", "uk": "en", "us": "en",
}

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:65] = 32
_FOLD[65:91] += 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of three bytes with a letter in the middle (ASCII in lower case, all other ASCII as gaps),
    and where each text (plus one) begins. Runs never leave their text."""
    folded = _FOLD[raw].astype(np.uint32)
    if len(folded) < 3:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(folded) + 1, bool)
    edge[offsets] = True
    ok = (folded[1:-1] != 32) & ~edge[1:-2] & ~edge[2:-1]
    at = np.flatnonzero(ok)
    run = folded[at] | folded[at + 1] << 8 | folded[at + 2] << 16
    hashed = (run * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
    return hashed.astype(np.int64), np.searchsorted(at, offsets)


class Model:
    """Log probabilities of the buckets for each language, and equal ones for a text in none of them."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = [*languages, UNKNOWN]
        size = 1 << BUCKET_BITS
        smooth = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * size))
        self.logs = np.concatenate([smooth, np.full((1, size), -np.log(size))]).astype(np.float32)

    def likelihoods(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of runs and, for each text and language, the log likelihood of its runs."""
        buckets, begins = grams(raw, offsets)
        out = np.zeros((len(offsets) - 1, len(self.logs)))
        for k, logs in enumerate(self.logs):
            sums = np.concatenate([[0.0], np.cumsum(logs[buckets], dtype=np.float64)])
            out[:, k] = np.diff(sums[begins])
        return np.diff(begins), out


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Count runs in about ``rows`` documents of each language, chosen by a hash of id and text (``labelled`` has ``text``,
    ``lang`` and ``key``). The counts that come to the driver are bounded by buckets and languages."""
    known = labelled.filter("lang IS NOT NULL AND lang <> '' AND text IS NOT NULL")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 1 << BUCKET_BITS)))
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, rows / sizes[lang])))])
    place = F.pmod(F.xxhash64(F.lit("lang"), "key"), F.lit(1 << 30)) / float(1 << 30)
    number = {lang: k for k, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(number), 1 << BUCKET_BITS), np.int64)
        for batch in batches:
            owner = np.array([number[x] for x in batch.column("lang").to_pylist()], np.int64)
            for first, raw, offsets in words.slices(batch.column("text")):
                buckets, begins = grams(raw, offsets)
                row = np.repeat(owner[first : first + len(offsets) - 1], np.diff(begins))
                sums += np.bincount(row << BUCKET_BITS | buckets, minlength=sums.size).reshape(sums.shape)
        row, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_pydict({"row": row, "bucket": bucket, "n": sums[row, bucket]})

    sample = known.filter(place < F.element_at(share, F.col("lang"))).select("lang", "text")
    found = sample.mapInArrow(count, "row long, bucket long, n long").groupBy("row", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), 1 << BUCKET_BITS))
    counts[found["row"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return Model(languages, counts)


def _grouped(rows: DataFrame, level: str, size: int) -> DataFrame:
    """Per host or domain the summed posteriors of its rows and their number, written once."""
    sums = F.array(*[F.sum(F.element_at("chances", k + 1)) for k in range(size)]).alias(f"{level}_sums")
    return write_once(rows.filter(F.col(level).isNotNull()).groupBy(F.col(level).alias(f"_{level}")).agg(sums, F.count("*").alias(f"{level}_rows")))


def evidence(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (any columns, and ``text``) with ``n_runs``, ``logs``, the tempered log likelihoods of the whole text, and
    ``chances``, what they alone say of each language; ``text`` is dropped."""
    kept = [c for c in rows.columns if c != "text"]
    schema = rows.select(*kept).schema.add("n_runs", "long")
    schema = schema.add("logs", T.ArrayType(T.DoubleType())).add("chances", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, raw, offsets in words.slices(batch.column("text")):
                n, logs = model.likelihoods(raw, offsets)
                own = [batch.column(c).slice(first, len(n)) for c in kept]
                logs *= TEXT_WEIGHT
                ends = pa.array(np.arange(len(n) + 1) * logs.shape[1], pa.int32())
                tables = [pa.ListArray.from_arrays(ends, pa.array(x.ravel())) for x in (logs, _chances(logs))]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), *tables], [*kept, "n_runs", "logs", "chances"])

    return rows.select(*kept, F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, schema)


def _chances(logs: np.ndarray) -> np.ndarray:
    powers = np.exp(logs - logs.max(axis=1, keepdims=True))
    return powers / powers.sum(axis=1, keepdims=True)


def _table(column: pa.Array, width: int) -> np.ndarray:
    """Lists of ``width`` numbers as rows; null lists as zeros."""
    out = np.zeros((len(column), width))
    out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def fuse(scored: DataFrame, model: Model) -> DataFrame:
    """``scored`` (from ``evidence``, with ``declared``, ``suffix``, ``host`` and ``domain``) with ``lang``, ``confidence``
    and ``accepted``.

    The posterior is proportional to: the tempered text likelihood; the declared language's and the address suffix's
    chance under each language (their trust if it is the one they name, the rest spread evenly; nothing if they are missing or
    name no known language); and the host's prior. Host priors are sums of the text posteriors grouped by host, smoothed by those of
    the domain, and these by those of all rows, each leaving out the row itself. The best language is accepted if its
    posterior is at least ``ACCEPT``, it is not ``und``, and there is any evidence.
    """
    languages, width = model.languages, len(model.languages)
    spoken = {x: k for k, x in enumerate(languages[:-1])}
    rows = write_once(scored)
    overall = rows.agg(*[F.sum(F.element_at("chances", k + 1)) for k in range(width)]).first()
    overall = np.array([x or 0.0 for x in overall]) + 1
    overall /= overall.sum()
    # the two tables are read from files, so their size decides how they are joined
    joined = rows
    for level in ("host", "domain"):
        joined = joined.join(_grouped(rows, level, width), F.col(level) == F.col(f"_{level}"), "left").drop(f"_{level}", level)
    kept = [c for c in scored.columns if c not in ("logs", "chances", "host", "domain", "suffix", "n_runs")]
    schema = scored.select(*kept).schema.add("lang", "string").add("confidence", "double").add("accepted", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            logs, own = _table(batch.column("logs"), width), _table(batch.column("chances"), width)
            prior = overall[None, :]
            for level in ("domain", "host"):
                others = np.maximum(batch.column(f"{level}_rows").fill_null(1).to_numpy(zero_copy_only=False) - 1, 0)
                sums = np.maximum(_table(batch.column(f"{level}_sums"), width) - own, 0) * (others > 0)[:, None]
                prior = (sums + HOST_WEIGHT * prior) / (sums.sum(axis=1, keepdims=True) + HOST_WEIGHT)
            logs += np.log(prior)
            declared = np.array([spoken.get(x, -1) for x in batch.column("declared").to_pylist()], np.int64)
            suffix = np.array([spoken.get(x, -1) for x in batch.column("suffix").to_pylist()], np.int64)
            for named, trust in ((declared, DECLARED_TRUST), (suffix, SUFFIX_TRUST)):
                at = np.flatnonzero(named >= 0)
                logs[at] += np.log((1 - trust) / (width - 1 or 1))
                logs[at, named[at]] += np.log(trust) - np.log((1 - trust) / (width - 1 or 1))
            posterior = _chances(logs)
            best = posterior.argmax(axis=1)
            top = posterior[np.arange(len(best)), best]
            any_evidence = (batch.column("n_runs").to_numpy(zero_copy_only=False) > 0) | (declared >= 0)
            found = [pa.array([languages[k] for k in best]), pa.array(top), pa.array(any_evidence & (best < width - 1) & (top >= ACCEPT))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *found], [*kept, "lang", "confidence", "accepted"])

    return joined.mapInArrow(run, schema)


def of_documents(docs: DataFrame) -> DataFrame:
    """Evidence columns of documents: ``lang`` is the declared language, ``source`` the host; there is no address."""
    none = F.lit(None).cast("string")
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        docs["text"].cast("string").alias("text"),
        F.lower(F.trim(docs["lang"].cast("string"))).alias("declared"),
        none.alias("suffix"),
        docs["source"].cast("string").alias("host"),
        none.alias("domain"),
        F.xxhash64(docs["doc_id"], docs["text"]).alias("key"),
    )


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence columns of web pages: text without markup, the ``lang`` of the html element, host, domain (its last two
    labels) and the language of the address suffix. Addresses without a host and missing markup are null."""
    markup = r"(?s)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>|&[a-z]+;"
    html = pages["html"].cast("string")
    host = F.lower(F.nullif(F.regexp_extract(pages["url"].cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))
    labels = F.split(host, r"\.")
    suffix = F.element_at(F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair]), F.element_at(labels, -1))
    declared = F.lower(F.nullif(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1), F.lit("")))
    return pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        F.regexp_replace(html, markup, " ").alias("text"),
        declared.alias("declared"),
        suffix.alias("suffix"),
        host.alias("host"),
        F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), ".").alias("domain"),
    )


def model_of(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    return train(of_documents(docs).withColumnRenamed("declared", "lang"), rows)


def document_languages(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, key, declared, lang, confidence, accepted`` per document (``key``: hash of id and text).

    Null and empty texts are judged by declared language and source alone; without a usable declaration they
    are not accepted. Null languages and sources give no evidence; repeated rows are judged each; ties go to the first language
    in alphabetical order; an empty table gives no rows.
    """
    rows = of_documents(docs)
    model = model or model_of(docs)
    return fuse(evidence(rows, model), model).select("doc_id", "key", "declared", "lang", "confidence", "accepted")


def page_languages(pages: DataFrame, model: Model) -> DataFrame:
    """``page_id, declared, lang, confidence, accepted`` per page; null html or url give no evidence of their kind."""
    return fuse(evidence(of_pages(pages), model), model).select("page_id", "declared", "lang", "confidence", "accepted")


def accepted_documents(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` (all columns) whose language is accepted. Rows are matched with their verdicts by id and
    text; only verdicts that reject are joined, so a table of accepted documents moves no text."""
    rejected = write_once(document_languages(docs, model).filter(~F.col("accepted")).select("doc_id", "key").distinct())
    mine = (docs["doc_id"].cast("long").eqNullSafe(rejected["doc_id"])) & (F.xxhash64(docs["doc_id"], docs["text"]) == rejected["key"])
    return docs.join(rejected, mine, "left_anti")
