"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: words, characters in words, symbols, repeated lines, and words that lie in
five-word windows found twice or more. The method then hashes every normalised line, counts the distinct
documents of each host that hold it (exact copies of a text count as one document), removes lines held
by more documents than a limit, and rejects documents that such removal leaves depleted. The limit is a fixed
number of documents, or a share of them in a small host, so it does not grow with the host.

Window repeats are found inside the row: hashes of five words; where all differ, which array_distinct
tells in linear time, nothing repeats; otherwise they are sorted with their places. Line counts are summed
on the map side first, and lines are joined to the frequent ones with a salt, so a hot host or line
spreads over many tasks. No text is shuffled by the rules themselves.

Defined cases: a null text has no words (it fails); a null host is a host of its own; repeated rows each get
the same verdict; extra columns are kept by `apply` and ignored by `judge`; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOL = "[#*$%&|<>]"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A line is removed if more distinct documents of the host hold it than LINE_DOCS, or in a small host than a share
#: of its documents; LEAST_DOCS may always hold it.
LINE_DOCS = 20
LINE_SHARE = 0.05
LEAST_DOCS = 3
#: A document is depleted if less than this share of its words is left.
LEAST_LEFT = 0.2
SALTS = 16


def normal_line(line):
    """A line with case, digits and spacing made equal."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), SPACE, " "))


def _lines(text):
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))


def base(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row a document: key, host, digest and the base counts."""
    one = docs.select(docs[key].alias("doc_id"), docs[host].alias("host"), F.coalesce(docs[text], F.lit("")).alias("t"))
    one = one.select(
        "doc_id", "host", F.xxhash64("t").alias("digest"),
        F.transform(F.regexp_extract_all("t", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("hw"),
        F.length(F.regexp_replace("t", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        _lines(F.col("t")).alias("lines"),
    )
    at = lambda i, k: F.get("hw", i + k)
    one = one.select(
        "doc_id", "host", "digest", "word_chars", "n_symbols", F.size("hw").cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.slice("hw", 1, F.greatest(F.size("hw") - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[at(i, k) for k in range(1, WINDOW)])).alias("win"),
    )
    rest = [c for c in one.columns if c != "win"]
    one = one.select(*rest, F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(F.transform("win", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).alias("pairs"))
    same = lambda p, j: F.coalesce(F.get("pairs", j)["x"] == p["x"], F.lit(False))
    one = one.select(*rest, F.sort_array(F.transform(F.filter("pairs", lambda p, j: same(p, j + 1) | F.when(j > 0, same(p, j - 1)).otherwise(False)), lambda p: p["i"])).alias("places"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate("places", zero, lambda a, p: F.struct((a["n"] + (p + WINDOW - F.greatest(p, a["end"]))).alias("n"), (p + WINDOW).alias("end")), lambda a: a["n"])
    one = one.select(*rest, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))
    # a filter on a count would be pushed down to the text, with each name replaced by all that it stands for, time
    # and again; it does not pass a generator
    return one.select(F.explode_outer(F.array(F.struct(*one.columns))).alias("b")).select("b.*")


def _rows(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """One row a document with its lines' hashes and word counts."""
    one = docs.select(docs[key].alias("doc_id"), docs[host].alias("host"), F.coalesce(docs[text], F.lit("")).alias("t"))
    plain = F.transform(_lines(F.col("t")), normal_line)
    return one.select("doc_id", "host", F.xxhash64("t").alias("digest"), plain.alias("norm")).select(
        "doc_id", "host", "digest", F.transform("norm", lambda x: F.struct(F.xxhash64(x).alias("line"), F.size(F.split(x, " ")).alias("words"))).alias("lines")
    )


def frequent_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(host, line): hashes of the lines that more documents of the host hold than the limits allow."""
    rows = _rows(docs, key, text, host)
    # outer: the filter that Spark derives for an inner explode would be pushed down and compute the lines anew
    held = rows.select("host", "digest", F.explode_outer(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line")).distinct()
    many = held.groupBy("host", "line").agg(F.count("line").alias("n")).filter(F.col("n") > LEAST_DOCS)
    hosts = rows.select(F.col("host").alias("h"), "digest").distinct().groupBy("h").agg(F.count("*").alias("docs"))
    limit = F.least(F.lit(float(LINE_DOCS)), F.greatest(F.lit(float(LEAST_DOCS)), F.col("docs") * LINE_SHARE))
    return many.join(hosts, F.col("host").eqNullSafe(F.col("h"))).filter(F.col("n") > limit).select("host", "line")


def _marked(docs: DataFrame, frequent: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(doc_id, host, digest, removed words, their hashes) of documents that hold a frequent line."""
    rows = _rows(docs, key, text, host)
    each = rows.select("doc_id", "host", "digest", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(SALTS)).alias("salt"), F.explode_outer("lines").alias("x")).select("doc_id", "host", "digest", "salt", "x.*")
    salted = frequent.select(F.col("host").alias("h"), F.col("line").alias("l"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("s"))
    hit = each.join(salted, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")) & (F.col("salt") == F.col("s")))
    # a repeated row adds its lines once more: judge() divides by the rows
    return hit.groupBy(F.col("doc_id").alias("m_doc"), F.col("host").alias("m_host"), F.col("digest").alias("m_digest")).agg(F.sum("words").alias("gone"), F.collect_set("line").alias("gone_lines"))


def _same(left: DataFrame, key: str = "doc_id"):
    return left[key].eqNullSafe(F.col("m_doc")) & left["host"].eqNullSafe(F.col("m_host")) & (left["digest"] == F.col("m_digest"))


def judge(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row a document with base counts, removed_words, base_failed and kept."""
    stats = base(docs, key, text, host)
    ids = docs.select(docs[key].alias("doc_id"), docs[host].alias("host"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("digest"))
    copies = ids.groupBy(F.col("doc_id").alias("m_doc"), F.col("host").alias("m_host"), F.col("digest").alias("m_digest")).agg(F.count("*").alias("rows"))
    marked = _marked(docs, frequent_lines(docs, key=key, text=text, host=host), key, text, host)
    twice = copies.filter("rows > 1")
    gone = marked.join(twice, ["m_doc", "m_host", "m_digest"], "left").withColumn("gone", F.expr("gone div coalesce(rows, 1)")).drop("rows", "gone_lines")
    out = stats.join(gone, _same(stats), "left").withColumn("removed_words", F.coalesce("gone", F.lit(0).cast("long")))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    depleted = F.col("n_words") - F.col("removed_words") < F.col("n_words") * LEAST_LEFT
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted).select("doc_id", "host", "digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "removed_words", "base_failed", "kept")


def apply(docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Documents that pass, without their frequent lines; columns as before."""
    cols = docs.columns
    marked = _marked(docs, frequent_lines(docs, key=key, text=text, host=host), key, text, host).select("m_doc", "m_host", "m_digest", "gone_lines")
    rejected = judge(docs, key=key, text=text, host=host).filter(~F.col("kept")).select(F.col("doc_id").alias("r_doc"), F.col("host").alias("r_host"), F.col("digest").alias("r_digest")).distinct()
    hit = rejected.join(marked, F.col("r_doc").eqNullSafe(F.col("m_doc")) & F.col("r_host").eqNullSafe(F.col("m_host")) & (F.col("r_digest") == F.col("m_digest")), "full")
    # one small table of decisions, so that the texts are dealt out once
    todo = hit.select(F.coalesce("r_doc", "m_doc").alias("m_doc"), F.coalesce("r_host", "m_host").alias("m_host"), F.coalesce("r_digest", "m_digest").alias("m_digest"), F.col("r_digest").isNotNull().alias("reject"), "gone_lines")
    named = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(cols)], docs[key].alias("doc_id"), docs[host].alias("host"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("digest"))
    out = named.join(todo, _same(named), "left").filter(~F.coalesce("reject", F.lit(False)))
    t = F.col(f"c{cols.index(text)}")
    left = F.array_join(F.filter(F.split(t, "\n", -1), lambda x: ~(x.rlike(WORD) & F.array_contains("gone_lines", F.xxhash64(normal_line(x))))), "\n")
    return out.select(*[(F.when(F.col("gone_lines").isNull(), t).otherwise(left) if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(cols)])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("host", "digest")


#: DuckDB SQL for op4: windows and lines are compared as text, not by hash.
OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), win AS (
  SELECT rid, i, array_to_string(words[i:i+4], ' ') AS k FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM w)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM dup, range(0, 5) r(j) GROUP BY rid
), ln AS (
  SELECT rid, host, t, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line
  FROM (SELECT rid, host, t, unnest(lines) AS x FROM w)
), freq AS (
  SELECT host, line, count(DISTINCT t) AS n FROM ln GROUP BY host, line HAVING count(DISTINCT t) > 3
), hosts AS (
  SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host
), gone AS (
  SELECT rid, sum(len(string_split(line, ' '))) AS n FROM ln
  WHERE (host, line) IN (SELECT f.host, f.line FROM freq f JOIN hosts h ON f.host = h.host WHERE f.n > least(20, greatest(3, h.docs * 0.05::DOUBLE))) GROUP BY rid
), s AS (
  SELECT w.doc_id, len(words) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS removed_words
  FROM w LEFT JOIN rep ON rep.rid = w.rid LEFT JOIN gone ON gone.rid = w.rid
)
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_words - removed_words < n_words * 0.2) AS kept FROM s
"""
