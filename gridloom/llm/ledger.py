"""Secret scanning with an incremental blob ledger.

Every historical version of a file is content-addressed by the SHA-256 of its text. The ledger
keeps, for each blob and rule version, the spans found, so that a scan reads only blobs that it has
not seen under the current rules; findings are then joined back to every path that holds the blob.

Ledger batches are folders of Parquet files; a batch without its _SUCCESS mark (an interrupted
write) is ignored and its blobs are scanned again.

Defined cases: a null text is the empty text; a null path or repeated row is kept as it is and gets
its blob's findings; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, scratch, small_batches, table, written

#: The base kinds in their listed order. Each has a pattern, the group whose length
#: counts, and its least length.
BASE_RULES = (
    ("assign", r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: A private key runs to its END line, over header lines and base64, or without one as far as its body goes. Line
#: ends may be written as \\n. What has been taken is not given back, so that no text takes more than linear time.
_GAP = r"(?:\s|\\[nr])*+"
_PEM = (
    r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:"
    rf"(?:{_GAP}(?:[A-Za-z][A-Za-z0-9-]*+:(?:(?!-----)[^\r\n\\])*+|[A-Za-z0-9+/=]++))*+{_GAP}-----END [A-Z ]{{0,40}}PRIVATE KEY-----"
    rf"|(?:{_GAP}(?:(?:Proc-Type|DEK-Info):[^\r\n\\]*+|[A-Za-z0-9+/]{{16,}}+={{0,2}}))*+(?:{_GAP}[A-Za-z0-9+/]{{1,15}}+(?:={{1,2}}|(?=\s*\Z)))?)"
)
#: Kinds that the method adds.
MORE_RULES = (
    ("pem", _PEM, 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("userinfo", r"://[A-Za-z0-9._%+-]*+:[^\s/:@]+@", 0, 0),
)
RULES = BASE_RULES + MORE_RULES
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def rule_version(rules=RULES) -> str:
    """Changes whenever a rule does."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find(text: str, compiled) -> list[tuple[str, int, int]]:
    """Spans of one text, ordered by start and then by the kind's place in the rules."""
    out = []
    for k, (kind, rx, group, least) in enumerate(compiled):
        for m in rx.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, kind, m.end()))
    out.sort()
    return [(kind, s, e) for s, _, kind, e in out]


def digest(text) -> F.Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class BlobLedger:
    """A ledger kept under `path`: which blobs were scanned under which rules, and what was found."""

    def __init__(self, spark: SparkSession, path: str, rules=RULES):
        self.spark, self.path, self.rules, self.version = spark, path.rstrip("/"), rules, rule_version(rules)

    def _batches(self) -> list[str]:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(sc._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
        return [p.toString() for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]

    def entries(self) -> DataFrame:
        """(blob, rule_version, findings) of all complete batches."""
        schema = f"blob string, rule_version string, findings {SPANS}"
        batches = self._batches()
        return self.spark.read.schema(schema).parquet(*batches) if batches else self.spark.createDataFrame([], schema)

    def findings(self) -> DataFrame:
        """(blob, findings) of the blobs that have any under the current rules."""
        known = self.entries().filter((F.col("rule_version") == self.version) & (F.size("findings") > 0))
        # two scans at once may have scanned the same blob, or a split partition; written, so that both sides of a join
        # with it are dealt out anew and a hot blob can be split
        return written(known.groupBy("blob").agg(F.first("findings").alias("findings")), "findings")

    def scan(self, versions: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
        """Scan unseen blobs of `versions`, add them to the ledger, and return (path, blob, findings) for each row."""
        small_batches(self.spark)
        rows = versions.select(versions[path].alias("path"), F.coalesce(versions[text], F.lit("")).alias("text"))
        keys = rows.select("path", digest(F.col("text")).alias("blob"))
        seen = self.entries().filter(F.col("rule_version") == self.version)
        # one row of each unseen blob stands for its copies: the smallest path, with a map-side minimum
        new = keys.groupBy("blob").agg(F.min("path").alias("rep")).join(seen.select("blob"), "blob", "left_anti")
        named = rows.withColumn("blob", digest(F.col("text")))
        todo = named.join(new.hint("shuffle_hash"), (named.blob == new.blob) & named.path.eqNullSafe(new.rep), "left_semi")
        rules = self.rules

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            compiled = [(k, re.compile(p), g, n) for k, p, g, n in rules]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            done: set[str] = set()
            for b in batches:
                # rows repeated whole are dealt to one task: their blob is scanned once
                rows = {x: t for x, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if x not in done}
                done |= rows.keys()
                got = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t, compiled)] for t in rows.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array(got, kind)], ["blob", "findings"])

        found = todo.select("blob", "text").mapInArrow(run, f"blob string, findings {SPANS}")
        batch = f"{self.path}/batch-{uuid.uuid4().hex}"
        found.select("blob", F.lit(self.version).alias("rule_version"), "findings").write.parquet(batch)
        return keys.join(self.findings(), "blob", "left").select("path", "blob", F.coalesce("findings", F.array().cast(SPANS)).alias("findings"))


def joined(spans: F.Column) -> F.Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, findings: DataFrame, text: str = "text") -> DataFrame:
    """Documents with each found span replaced by [kind]; overlapping spans count as one, named by the first.
    findings: (blob, findings), one row a blob that has spans. Only texts that may have spans are dealt out, as long as
    hashes of their blobs can be broadcast; beyond that all are."""
    cols = docs.columns
    marks = written(findings.select(F.xxhash64("blob").alias("__mark")).distinct(), "marks")
    named = docs.withColumn("__blob", digest(F.col(text))).withColumn("__mark", F.xxhash64("__blob"))
    few = marks.count() <= BROADCAST_ROWS
    some = named.join(F.broadcast(marks), "__mark", "left_semi") if few else named
    hit = some.join(findings.select(F.col("blob").alias("__blob"), F.col("findings").alias("__found")), "__blob", "left")
    # fold over the spans in order: what has been put out so far, and where the text goes on
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(acc, x):
        free = x["start"] >= acc["at"]
        gap = F.substring(F.col(text), (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.struct(F.when(free, F.concat(acc["out"], gap, F.lit("["), x["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    done = F.aggregate("__found", start, step, lambda a: F.concat(a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), F.length(text))))
    out = hit.withColumn(text, F.when(F.col("__found").isNull(), F.col(text)).otherwise(done)).select(*cols)
    return out.unionByName(named.join(F.broadcast(marks), "__mark", "left_anti").select(*cols)) if few else out


def op2_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ledger = BlobLedger(spark, scratch(spark, "ledger"))
    found = ledger.scan(docs, path="doc_id")
    count = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("findings", lambda x: x["kind"].isin("assign", "access", "hex"))
    return found.select(F.col("path").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))
