"""Secret scan over an incremental blob ledger, with DataFrame functions only.

Each text is a version of its path and is content-addressed by SHA-256. A ledger
table remembers which blob was scanned by which version of which rule, and what
was found. A run scans only unseen pairs of blob and rule version, appends to
the ledger, and joins the findings back to every row that holds the blob.

Positions come from the built-in functions alone: the pieces between matches
and the matches alternate, so a running sum of their lengths gives each match's
start. That sum is a window over exploded matches, linear in their number.

Defined cases: null text is the empty blob; equal texts share a blob and get the
same findings; every row of the input, repeated or with a null key, is
returned once; an empty table gives an empty result; only ``keep`` columns are carried along, whatever their names; a very long text is one
blob, scanned whole: its matches, not its characters, become rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinmap.llm.common import fresh, shared_dir, spread, table

#: Letters of the assignment rule's keyword count in either case; spelled out, so that no engine folds beyond ASCII.
WORDS = "|".join("".join(c if c in "_?" else f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` (0: the whole match) must have ``least`` characters. ``version`` changes with any of them."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


BASE = (
    Rule("assign", rf"({WORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: What the scan adds to the base rules.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
SPAN = "struct<start:long,rule_no:int,kind:string,end:long>"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scannable(rule: Rule) -> str:
    """The pattern as it is scanned. A run of one class that is too short can be passed over at once:
    the class takes all it can, so a longer match never starts inside a shorter run."""
    run = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return f"{run[1]}{{{rule.least},}}" if run and rule.group == 0 else rule.pattern


def hits(text: Column, rule: Rule, no: int) -> Column:
    """Array of matches: rule_no, number, characters before it since the last one, its characters, kept or not."""
    pattern = F.lit(scannable(rule))
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    gaps = F.transform(F.split(text, scannable(rule), -1), F.length)
    zipped = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("long"), F.transform(part, F.length).alias("part"))
    found = F.transform(
        F.slice(zipped, 1, F.size(whole)),
        lambda x, i: F.struct(F.lit(no).alias("rule_no"), i.alias("i"), x["gap"].cast("long").alias("gap"), x["long"].cast("long").alias("long"), (x["part"] >= rule.least).alias("kept")),
    )
    return F.when(text.rlike(scannable(rule)), found).otherwise(F.array().cast("array<struct<rule_no:int,i:int,gap:bigint,long:bigint,kept:boolean>>"))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text[, done: rule names]) -> (blob, rules, spans): one row for each blob that a rule was unseen for."""
    names = [r.name for r in rules]
    if "done" in blobs.columns:
        blobs = blobs.withColumn("rules", F.array_except(F.array(*map(F.lit, names)), F.coalesce("done", F.array().cast("array<string>")))).filter(F.size("rules") > 0)
    else:
        blobs = blobs.withColumn("rules", F.array(*map(F.lit, names)))
    none = F.array().cast("array<struct<rule_no:int,i:int,gap:bigint,long:bigint,kept:boolean>>")
    every = F.concat(*[F.when(F.array_contains("rules", r.name), hits(F.col("text"), r, i)).otherwise(none) for i, r in enumerate(rules)])
    found = blobs.select("blob", "rules", F.explode_outer(every).alias("h")).select("blob", "rules", "h.*")
    order = W.partitionBy("blob", "rule_no").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    ends = found.withColumn("end", F.sum(F.col("gap") + F.col("long")).over(order))
    kinds = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule_no") + 1)
    span = F.when(F.col("kept"), F.struct((F.col("end") - F.col("long")).alias("start"), "rule_no", kinds.alias("kind"), F.col("end")))
    return ends.groupBy("blob").agg(F.first("rules").alias("rules"), F.collect_list(span).cast(f"array<{SPAN}>").alias("spans"))


def update_ledger(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", fresh: bool = False) -> DataFrame:
    """Scan what the ledger at this path hasn't seen, append it, and return the ledger's table.

    ``fresh``: no ledger is there yet. Texts are deduplicated before they cross the network, then
    once more after; the scan, the running sums and the ledger rows all keep that partitioning.
    """
    spark = docs.sparkSession
    t = F.col(f"`{text}`")
    blobs = docs.select(blob_id(t).alias("blob"), F.coalesce(t, F.lit("")).alias("text")).dropDuplicates(["blob"])
    if not fresh:
        done = spark.read.parquet(ledger).groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("done"))
        blobs = blobs.join(done, "blob", "left")
    scan_blobs(blobs, rules).write.mode("append").parquet(ledger)
    return spark.read.parquet(ledger)


def findings(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "spans") -> DataFrame:
    """Every row's ``keep`` columns and, as ``out``, its spans by these rules: sorted by start, then rule. A blob that the ledger
    has nothing of has none. Only blobs with spans meet the rows, and the rows of a blob with many meet it in shares."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    live = F.filter("spans", lambda s: F.array_contains(F.transform("rules", lambda r: F.split(r, "@")[0]), s["kind"]))
    current = ledger.withColumn("rules", F.filter("rules", lambda r: F.map_contains_key(order, r))).select("blob", live.alias("spans"))
    kinds = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    one = F.transform(F.flatten(F.collect_list("spans")), lambda s: F.struct(s["start"], F.element_at(kinds, s["kind"]).alias("rule_no"), s["kind"], s["end"]))
    by_blob = current.groupBy("blob").agg(F.sort_array(one).alias("_spans")).filter(F.size("_spans") > 0)
    blob, spans = fresh(docs, "_blob"), fresh(docs, "_spans")
    share = fresh(docs, "_share")
    paths = docs.select(*[F.col(f"`{c}`") for c in keep], blob_id(F.col(f"`{text}`")).alias(blob), F.xxhash64(*[F.col(f"`{c}`") for c in keep]).alias(share))
    by_blob = by_blob.select(F.col("blob").alias(blob), F.col("_spans").alias(spans))
    none = F.array().cast(by_blob.schema[spans].dataType)
    return spread(paths, by_blob, blob, share, "left").select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(spans), none).alias(out))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = findings(docs, update_ledger(docs, shared_dir(spark), fresh=True))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select("doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    quoted = lambda r: "'" + r.pattern.replace("'", "''").replace('\\"', '"') + "'"
    each = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, {quoted(r)}) AS ms, regexp_extract_all(t, {quoted(r)}, {r.group}) AS gs, string_split_regex(t, {quoted(r)}) AS gaps FROM d"
        for i, r in enumerate(BASE + MORE)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({each}),
u AS (SELECT doc_id, k, kind, least, i, length(gaps[i]) AS gap, length(ms[i]) AS ml, length(gs[i]) AS gl
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)),
s AS (SELECT *, sum(gap + ml) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM u),
f AS (SELECT doc_id, k, kind, CAST(e - ml AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM s WHERE gl >= least)
SELECT d.doc_id,
       count(*) FILTER (WHERE kind = 'assign') AS n_assign,
       count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) FILTER (WHERE k < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k), '') AS spans
FROM d LEFT JOIN f USING (doc_id) GROUP BY d.doc_id"""


OP9_SQL = _oracle()
