"""Benchmark passages in documents by a prefix-filtered join of shingles.

An item's windows are its runs of ``span`` words (an item of fewer words is one window).  A window
is the set of its shingles with their places; a shingle is a run of ``size`` words (a shorter
window is one shingle).  A document contains a window if it has all its shingles at the right
distances.

1. *Matches.*  The shingles of all documents are joined with the distinct shingles of the windows.
   What matches is kept per distinct text, with its place and the number of rows that share it.
2. *Rarity.*  The matches give the number of occurrences of every shingle in the documents.  A
   window with a shingle that never occurs cannot occur and goes.
3. *Prefix.*  All shingles of a window have to be present, so its prefix is one shingle: the rarest.
   Matches of prefix shingles propose where a window starts; a window has to lie within the text
   (bounds on place and length).
4. *Verification.*  A proposed window is kept if the text matches each of its shingles at its place.

Everything is DataFrame functions.  Texts are read twice (for matches and for the final rows) and
never shuffled; only matches are.  The window tables are written before they are joined, so that
Spark knows their size: it broadcasts what is below its limit and shuffles both sides otherwise.
A text is known by 128 bits of hashes and a shingle by 64; a window of ten words has to agree in
six successive shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from panelwave.llm.common import stored

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: A word is a run of characters other than ASCII ones that are neither digits nor letters.
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in the form that Java scans fastest: listed characters are one look-up in a table, every
#: range is a call.  First for texts that are ASCII only.
_ASCII_LOWER = f"[{_DIGITS}{_LOWER}]+"
_ANY_LOWER = rf"[{_DIGITS}{_LOWER}\x{{80}}-\x{{10FFFF}}]+"
_ASCII_RAW = f"[{_DIGITS}{_LOWER}{_UPPER}]+"
_ANY_RAW = rf"[{_DIGITS}{_LOWER}{_UPPER}\x{{80}}-\x{{10FFFF}}]+"
_TEXT = ["k1", "k2"]


def _ascii_only(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def _words(text: Column) -> Column:
    """Words of a text with A-Z in lower case (null: none)."""
    body = F.coalesce(text, F.lit(""))
    plain = F.regexp_extract_all(F.lower(body), F.lit(_ASCII_LOWER), F.lit(0))  # here only A-Z have a lower case
    other = F.regexp_extract_all(F.translate(body, _UPPER, _LOWER), F.lit(_ANY_LOWER), F.lit(0))
    return F.when(_ascii_only(body), plain).otherwise(other)


def _n_words(text: Column) -> Column:
    """Number of the words, on the text as it is."""
    body = F.coalesce(text, F.lit(""))
    plain, other = F.regexp_count(body, F.lit(_ASCII_RAW)), F.regexp_count(body, F.lit(_ANY_RAW))
    return F.when(_ascii_only(body), plain).otherwise(other).cast("long")


def _text_key(text: Column) -> list[Column]:
    body = F.coalesce(text, F.lit(""))
    return [F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), body).alias("k2")]


def _shingles(words: Column, n: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words, in the order of their places."""

    def at(i: Column) -> Column:
        return F.xxhash64(F.lit(size), *[F.get(words, i + j) for j in range(size)])

    return F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), at)).otherwise(F.array().cast("array<long>"))


def text_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(k1, k2, w, n): the words of every text.  Texts without words stay, as a filter on n would make
    Spark look for the words once more."""
    body = F.col(f"`{text}`")
    return docs.select(*_text_key(body), _words(body).alias("w")).withColumn("n", F.size("w"))


def item_windows(items: DataFrame, span: int = 10, text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(win, words, len, item): windows of every item; ``win`` is the window's words joined by a space."""
    rows = items.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), _words(F.col(f"`{text}`")).alias("w")
    )
    rows = rows.where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(span)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    rows = rows.select("item", "len", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.col("len")))).alias("words"))
    return rows.select(F.concat_ws(" ", "words").alias("win"), "words", "len", "item")


def contained_windows(
    docs: DataFrame, windows: DataFrame, size: int = 5, text: str = "text"
) -> DataFrame:
    """(k1, k2, s, len, win): every place of a distinct text where a window starts.

    ``windows`` has win, words and len.
    """
    distinct = windows.groupBy("win", "len").agg(F.first("words").alias("words"))
    width = F.least(F.col("len"), F.lit(size))
    lengths = [r["width"] for r in distinct.select(width.alias("width")).distinct().collect()]  # 1 to size
    sizes = sorted(lengths, reverse=True) or [size]
    hashes = F.array().cast("array<long>")
    for k in sizes:
        hashes = F.when(width == k, _shingles(F.col("words"), F.col("len"), k)).otherwise(hashes)
    parts = stored(distinct.select("win", "len", width.alias("width"), F.posexplode(hashes).alias("off", "h")), "shingles")
    marks = stored(parts.select("h", "width").distinct(), "marks")

    read = text_words(docs, text)
    # The shingles of each size stand behind those of the greater sizes.
    listed = [_shingles(F.col("w"), F.col("n"), k) for k in sizes]
    listed = F.concat(*listed) if len(listed) > 1 else listed[0]
    skipped, before = F.lit(0), F.lit(0)
    for k in sizes:
        skipped = F.when(F.col("width") == k, before).otherwise(skipped)
        before = before + F.greatest(F.col("n") - k + 1, F.lit(0))
    found = read.select(*_TEXT, "n", F.posexplode(listed).alias("nth", "h")).join(marks, "h")
    found = found.select(*_TEXT, "n", (F.col("nth") - skipped).alias("pos"), "h")
    matches = stored(found.groupBy(*_TEXT, "n", "pos", "h").agg(F.count(F.lit(1)).alias("copies")), "matches")

    often = matches.groupBy("h").agg(F.sum("copies").alias("often"))
    # One row a window; it has as many shingles as rows here unless one never occurs.
    rarest = parts.join(often, "h").groupBy("win", "len", "width").agg(
        F.count(F.lit(1)).alias("present"), F.min(F.struct("often", "off", "h")).alias("rare")
    )
    need = F.col("len") - F.col("width") + 1
    prefix = rarest.where(F.col("present") == need).select("win", "len", need.alias("need"), "rare.off", "rare.h")
    start = F.col("pos") - F.col("off")
    proposed = matches.join(prefix, "h").where((start >= 0) & (start + F.col("len") <= F.col("n")))
    proposed = stored(proposed.select(*_TEXT, start.alias("s"), "win", "len", "need"), "proposed")

    single = proposed.where("need = 1").select(*_TEXT, "s", "len", "win")
    asked = proposed.where("need > 1").join(parts.select("win", "off", "h"), "win")
    asked = asked.select(*_TEXT, "s", "len", "win", "need", (F.col("s") + F.col("off")).alias("pos"), "h")
    held = asked.join(matches.select(*_TEXT, "pos", "h"), [*_TEXT, "pos", "h"])
    whole = held.groupBy(*_TEXT, "s", "len", "win", "need").agg(F.count(F.lit(1)).alias("got")).where("got = need")
    return single.unionByName(whole.select(*_TEXT, "s", "len", "win"))


def _covered(spans: Column) -> Column:
    """Words covered by sorted (s, e) spans together."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("sum"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.greatest(x["e"] - F.greatest(x["s"], acc["end"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], x["e"]).alias("end"), (acc["sum"] + fresh).alias("sum"))

    return F.aggregate(spans, zero, step)["sum"]


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    span: int = 10,
    size: int = 5,
    text: str = "text",
    doc_id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit (words inside an occurrence of a window), n_items
    (items with an occurring window), items (their ids as sorted strings), ``spans`` (start and end
    of every occurrence, sorted, not merged), items_sha256 (of the ids, comma-joined) and
    contaminated (n_hit > 0).

    Words are compared with A-Z in lower case.  A null text has no words, neither has one of
    punctuation only; such documents are clean and such items have no window.  Copies share their
    hits; repeated rows and null ids are kept, each with its row.  Items of equal id count once
    in n_items, with the windows of all their rows; a null item id is the empty string.  Without items
    every document is clean; without documents the result is empty.
    """
    windows = stored(item_windows(items, span, item_text, item_id), "windows")
    hits = stored(contained_windows(docs, windows, size, text), "hits")
    of_item = windows.select("win", "item").distinct()
    named = hits.select(*_TEXT, "win").distinct().join(of_item, "win").select(*_TEXT, "item").distinct()
    names = named.groupBy(*_TEXT).agg(F.array_sort(F.collect_list("item")).alias("items"))
    placed = hits.select(*_TEXT, "s", (F.col("s") + F.col("len")).alias("e")).distinct()
    spans = placed.groupBy(*_TEXT).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    per_text = stored(spans.join(names, _TEXT).withColumn("n_hit", _covered(F.col("spans"))), "per_text")

    body = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), *_text_key(body), _n_words(body).alias("n_words"))
    items_found = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(per_text, _TEXT, "left").select(
        F.col("id").alias(doc_id),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_found).cast("long").alias("n_items"),
        items_found.alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>")).alias("spans"),
        F.sha2(F.concat_ws(",", items_found), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def oracle() -> str:
    """DuckDB SQL for ``find_contamination(documents, benchmark)``."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{ITEM_WORD}')"
    return rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {words} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words} AS w FROM benchmark),
i AS (SELECT item, w, least(len(w), 10) AS l FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item, l, array_to_string(w[k:k + l - 1], ' ') AS win FROM (SELECT item, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM i)),
o AS (SELECT row, k, l, array_to_string(w[k:k + l - 1], ' ') AS win FROM
  (SELECT row, w, l, unnest(range(1, len(w) - l + 2)) AS k FROM d, (SELECT DISTINCT l FROM v) WHERE len(w) >= l)),
h AS (SELECT row, k, o.l, item FROM o JOIN v USING (win, l)),
c AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(range(k, k + l)) AS p FROM h) GROUP BY row),
n AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM h) GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (row) LEFT JOIN n USING (row)"""
