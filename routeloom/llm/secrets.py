"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed (SHA-256 of its text). The ledger holds (blob, rule_version, findings).
A run takes the distinct blobs whose (blob, rule_version) the ledger lacks, scans those alone, adds them, and joins
findings back to all paths. A new rule version scans all blobs again and leaves older entries in place.

A kind's matches and their places come from splitting the text by its pattern: the lengths of the parts between and of
the matches add up to code-point offsets. No Python runs on executors.

Scale: one shuffle of blobs; copies collapse within each task before it, so a blob that very many paths share is at most
one row a task in it; the ledger's names are taken out in the same partitioning. The join back is on the blob with
nothing above it that needs a blob's rows together, so AQE can split a blob that very many paths share.

Defined results: a null text is an empty blob without findings; rows of equal path are versions, each returned; a null
path is returned as it is; an empty table gives an empty result and leaves the ledger as it was. Only the columns named
are used, so others, whatever their names, play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

RULE_VERSION = 1
#: (kind, pattern, group whose length counts, least length); fixed values.
RULES = (
    ("assign", r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # runs shorter than 16 fail anyway; this form doesn't list them first
)
FINDING = "array<struct<start:int,rank:int,end:int,kind:string>>"
LEDGER = f"blob string, rule_version int, findings {FINDING}"


def spans_of(text: Column, kind: str, rank: int, pattern: str, group: int, least: int) -> Column:
    """Findings of one kind: leftmost matches that don't overlap, then those of a long enough group."""
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.zip_with(F.zip_with(gaps, whole, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"))), value, lambda x, v: F.struct(x["g"].alias("g"), x["m"].alias("m"), F.length(v).alias("v")))
    none = F.from_json(F.lit("[]"), FINDING)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["g"]
        end = start + x["m"]
        hit = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["v"] >= least, F.concat(acc["found"], hit)).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda acc: acc["found"])
    return F.when(text.rlike(pattern), found).otherwise(none)


def findings(text: Column, rules=RULES) -> Column:
    """All findings of a text by start, then by the rules' order."""
    return F.array_sort(F.concat(*[spans_of(text, kind, rank, pattern, group, least) for rank, (kind, pattern, group, least) in enumerate(rules)]))


def blob_of(text: str = "text") -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def update(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules=RULES, rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(entries of this rule version: blob, findings; new ledger entries, to be added to the ledger)."""
    spark = docs.sparkSession
    ledger = spark.createDataFrame([], LEDGER) if ledger is None else ledger.select("blob", "rule_version", "findings")
    known = ledger.where(F.col("rule_version") == rule_version).dropDuplicates(["blob"])
    versions = docs.select(blob_of(text).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    blobs = versions.groupBy("blob").agg(F.first("body").alias("body")).join(known.select("blob"), "blob", "left_anti")
    added = cut(blobs.select("blob", F.lit(rule_version).alias("rule_version"), findings(F.col("body"), rules).alias("findings")), "ledger")
    return known.unionByName(added).select("blob", "findings"), added


def scan(docs: DataFrame, ledger: DataFrame | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text", rules=RULES, rule_version: int = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(the columns ``keep`` of every row of docs, with its blob and findings; new ledger entries)."""
    entries, added = update(docs, ledger, text, rules, rule_version)
    kept = [c for c in keep if c.lower() not in ("blob", "findings", "_hits", "_name")]
    hits = entries.where(F.size("findings") > 0).select(F.col("blob").alias("_name"), F.col("findings").alias("_hits"))
    named = docs.select(*kept, blob_of(text).alias("blob")).join(hits, F.col("blob") == F.col("_name"), "left")
    return named.select(*kept, "blob", F.coalesce("_hits", F.from_json(F.lit("[]"), FINDING)).alias("findings")), added


def scan_incrementally(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), text: str = "text", rules=RULES, rule_version: int = RULE_VERSION) -> DataFrame:
    """As scan(), with a ledger that stays at ``path`` (Parquet): blobs that it has under this rule version are not
    scanned, what is new is added to it. A run that stops before the addition leaves it as it was."""
    spark = docs.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    found, added = scan(docs, spark.read.schema(LEDGER).parquet(path) if there else None, keep, text, rules, rule_version)
    found = cut(found, "findings")  # joined with the ledger as it was
    added.write.mode("append").parquet(path)
    return found


def redact(text: Column, found: Column) -> Column:
    """The text with every finding, or run of findings that overlap, replaced by its first one's kind in brackets."""

    def step(acc: Column, x: Column) -> Column:
        new = x["start"] >= acc["at"]
        out = F.when(new, F.concat(acc["out"], text.substr(acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], x["end"]).alias("at"))

    done = F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def digest(found: DataFrame, path: str = "doc_id") -> DataFrame:
    """Counts by kind, the spans as text and their digest."""
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    said = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select(path, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(said.cast("binary"), 256).alias("base_sha256"), said.alias("spans"))
