"""Secret scans over a ledger of blobs.

Every text, of every version of every path, is a blob named by the SHA-256 of its content.  The
ledger holds the pairs of blob and rule version that have been scanned, with the spans found.  A
scan takes the distinct blobs of the rows, removes the pairs that the ledger has, scans only the
rest, adds them to the ledger and joins the findings back to all rows.  All of it is DataFrame
functions: no Python runs on the executors.

Positions.  Spark's functions return matches but not their places.  Splitting a text by the same
pattern gives the pieces between the matches; the lengths of pieces and matches, summed up in turn,
are the places (in code points).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelwave.llm.common import stored


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose group ``group`` has ``least``
    characters or more.  A changed rule needs a new version."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


#: The three base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),  # as long runs of [A-Z0-9]+ that pass a check of 20 characters
    Rule("hex", r"[0-9a-f]{24,}"),  # as long runs of [0-9a-f]+ that pass a check of 24
)
#: Further kinds: private key headers, signed web tokens and tokens with an issuer's prefix.
MORE = (
    Rule("private", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    Rule("prefixed", r"(?:ghp_|gho_|glpat-|xox[abp]-|sk_live_)[A-Za-z0-9_-]+", 20),
)
RULES = BASE + MORE
_SPANS = "array<struct<start:int,end:int>>"


def _spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule's matches in a text."""
    pattern = F.lit(rule.pattern)
    cut, whole = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    part = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    steps = F.arrays_zip(F.transform(cut, lambda x: F.length(x)).alias("gap"), whole.alias("whole"), part.alias("part"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["whole"])
        hit = F.length(x["part"]) >= rule.least
        more = F.when(hit, F.concat(acc["found"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["found"])
        return F.struct(F.coalesce(end, start).alias("at"), more.alias("found"))

    return F.aggregate(steps, zero, step)["found"]


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, rule, spans) for every pair of blob and rule that is open, in one pass over the texts.

    ``blobs`` has blob and text, and optionally ``known``, the names of the rules that the blob has been
    scanned for (null: none).
    """
    none = F.lit(None).cast(f"struct<rule:string,spans:{_SPANS}>")
    found = []
    for rule in rules:
        spans = F.when(F.col("text").rlike(rule.pattern), _spans(F.col("text"), rule)).otherwise(F.array().cast(_SPANS))
        pair = F.struct(F.lit(rule.name).alias("rule"), spans.alias("spans"))
        if "known" in blobs.columns:
            pair = F.when(F.coalesce(F.array_contains("known", rule.name), F.lit(False)), none).otherwise(pair)
        found.append(pair)
    pairs = blobs.select("blob", F.explode(F.array(*found)).alias("f"))
    return pairs.where("f is not null").select("blob", "f.rule", "f.spans")


def _rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    return rows.withColumn("blob", F.sha2("text", 256))


def distinct_blobs(docs: DataFrame, text: str = "text") -> DataFrame:
    """(blob, text): every distinct text of the rows once; a null text is the empty one."""
    return _rows(docs, text, text).groupBy("blob").agg(F.first("text").alias("text"))


def find_secrets(
    docs: DataFrame,
    ledger: DataFrame | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    rules: tuple[Rule, ...] = RULES,
    blobs: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Findings of every row, and the ledger entries that this scan adds.

    Findings: doc_id, blob and ``found``, an array of (kind, start, end) sorted by start, then by
    the order of the rules.  New entries: blob, rule, spans; an entry is made for every pair, with
    an empty array where nothing was found.  ``ledger`` may hold any earlier entries.  ``blobs`` takes
    the ``distinct_blobs`` of the rows if they are written somewhere already.

    A null text is the empty blob.  Repeated rows and copies share a blob, which is scanned once,
    and each gets its row; a null id stays null.  An empty table gives empty results.
    """
    rows = _rows(docs, text, doc_id)
    blobs = distinct_blobs(docs, text) if blobs is None else blobs
    if ledger is None:
        fresh = scan_blobs(blobs, rules)
    else:
        known = ledger.where(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("known"))
        open_ = blobs.join(known, "blob", "left").where(F.coalesce(F.size("known"), F.lit(0)) < len(rules))
        fresh = scan_blobs(open_, rules)
    fresh = stored(fresh, "ledger")
    entries = fresh if ledger is None else fresh.unionByName(ledger.select("blob", "rule", "spans").where(F.col("rule").isin([r.name for r in rules])))
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    listed = F.transform(
        "spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("rule")].alias("nth"), s["end"].alias("end"))
    )
    hits = (
        entries.where(F.size("spans") > 0)
        .select("blob", F.explode(listed).alias("s"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list("s")).alias("s"))
    )
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    named = F.transform("s", lambda s: F.struct(kinds[s["nth"]].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    hits = hits.select("blob", named.alias("found"))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    back = rows.select("doc_id", "blob").join(hits, "blob", "left")
    return back.select(F.col("doc_id").alias(doc_id), "blob", F.coalesce("found", none).alias("found")), fresh


def joined(found: Column) -> Column:
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _equals(kind: str) -> Callable[[Column], Column]:
    return lambda x: x == kind


def summary(findings: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Counts and digests of findings."""
    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE]))
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, _equals(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return findings.select(doc_id, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every span, overlapping ones together, replaced by ``mark``."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        before = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(fresh, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    done = F.aggregate(found, zero, step)
    return F.when(F.size(found) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def oracle() -> str:
    """DuckDB SQL for ``summary(find_secrets(documents))``."""
    kinds = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        kinds.append(
            f"""SELECT doc_id, {i} AS nth, '{r.kind}' AS kind, starts, wholes, parts, {r.least} AS least FROM (
  SELECT doc_id, string_split_regex(text, '{p}') AS cut, regexp_extract_all(text, '{p}', 0) AS wholes,
    regexp_extract_all(text, '{p}', {r.group}) AS parts,
    list_transform(range(1, len(wholes) + 1), lambda i: list_sum(list_transform(cut[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(wholes[1:i-1], lambda x: length(x))), 0)) AS starts
  FROM d WHERE regexp_matches(text, '{p}'))"""
        )
    base = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    listed = "coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, nth) {}, '')"
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({' UNION ALL '.join(kinds)}),
s AS (SELECT doc_id, nth, kind, a, a + length(w) AS b FROM (
  SELECT doc_id, nth, kind, CAST(unnest(starts) AS BIGINT) AS a, unnest(wholes) AS w, unnest(parts) AS p, least FROM f)
  WHERE length(p) >= least)
SELECT d.doc_id, {base}, sha256({listed.format("FILTER (nth < 3)")}) AS base_sha256, {listed.format("")} AS spans
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.row, d.doc_id"""
