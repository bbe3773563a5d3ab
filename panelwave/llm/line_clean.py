"""Line-first cleaning of documents.

Every line of a text is judged by itself; failing lines are removed, and a document that loses
too much of its text goes.  All rules look at one document, so the operator is a single scan
without a shuffle, and no group of rows ever meets in a task.

Line rules (parameters of ``LineRules``)
  punctuation  the line has no sentence mark at its end and none inside for a long stretch, or
               shouts: doubled exclamation marks follow a large share of its words
  navigation   table, menu and markup characters make up a large share of the line
  boilerplate  the line holds one of the stock phrases
  repetition   the line equals an earlier line of its document
A line without a word is neither kept nor counted as a loss.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelwave.llm.common import by_slices, texts_of
from panelwave.llm.wordscan import BYTE_BASE, WORD_BASE, U, Words, mix, per_row, prefix, run_hash

#: Stock phrases of web pages, and the symbols that the base statistics count.
PHRASES = (
    "javascript",
    "lorem ipsum",
    "cookie",
    "terms of use",
    "privacy policy",
    "all rights reserved",
    "sign in",
    "log in",
    "subscribe to",
    "click here",
    "licensed under",
)
SYMBOLS = b"#*$%&|<>"

OUTPUT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_lines_failed long, lost_share double, clean_text string"
)


@dataclass(frozen=True)
class LineRules:
    symbol_share: float = 0.08  #: symbols against characters of the line's words
    shout_share: float = 0.25  #: doubled exclamation marks against words
    open_words: int = 60  #: words that a line may run on without any sentence mark
    lost_share: float = 0.5  #: a document goes if it loses more of its characters
    min_words: int = 20
    repeat_percent: int = 30
    window: int = 8
    phrases: tuple[str, ...] = PHRASES
    phrase_share: float = 0.125  #: a line fails if whole-word phrases hold as much of its characters
    menu_lines: int = 5  #: as many short lines without a sentence mark, one after the other, are a menu
    menu_words: int = 3  #: words of such a short line at most


def _flag(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _MARK = _flag(SYMBOLS), _flag(b".!?;:")
#: Sentence marks of other scripts (ideographic, full-width, Devanagari, Arabic, Urdu,
#: Armenian, Ethiopic, Khmer, Burmese) and the ellipsis.
WIDE_MARKS = "。．！？；：।॥؟؛۔։።៖។၊။…"
_WIDE = re.compile("|".join(map(re.escape, WIDE_MARKS)).encode())


def _counter(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def _equal_earlier(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Marks the entries whose value occurs earlier in the same row (entries in order)."""
    order = np.lexsort((np.arange(len(row)), value, row))
    out = np.zeros(len(row), bool)
    same = (row[order][1:] == row[order][:-1]) & (value[order][1:] == value[order][:-1])
    out[order[1:]] = same
    return out


def _menus(row: np.ndarray, short: np.ndarray, least: int) -> np.ndarray:
    """Marks the short lines that stand in runs of ``least`` or more within a row."""
    out = np.zeros(len(row), bool)
    if len(row):
        begin = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (short[1:] != short[:-1])))
        size = np.diff(np.append(begin, len(row)))
        out = np.repeat((size >= least) & short[begin], size)
    return out


def _clean(part: pa.RecordBatch, column: str, rules: LineRules, keep: list[str], with_text: bool) -> pa.RecordBatch:
    text = texts_of(part.column(column))
    w = Words(text)
    n, data, rows = w.count, w.data, w.rows
    lead = (data & 0xC0) != 0x80
    chars, symbols = _counter(lead & w.inside), _counter(_SYMBOL[data])
    marked = _MARK[data]
    if not lead.all():
        marked[np.fromiter((m.start() for m in _WIDE.finditer(data.tobytes())), np.int64)] = True
    marks = _counter(marked)
    bang = data == 0x21
    double = np.zeros(len(data), bool)
    double[1:] = bang[1:] & bang[:-1]
    shouts = _counter(double)
    span = w.offsets
    word_chars, n_symbols = chars[span[1:]] - chars[span[:-1]], symbols[span[1:]] - symbols[span[:-1]]

    # words inside windows that occur twice or more in their text
    size = rules.window
    at = w.windows(size)
    repeated = np.zeros(rows, np.int64)
    if len(at):
        h = run_hash(prefix(w.hash, WORD_BASE), at, at + size, WORD_BASE)
        row = w.doc[at]
        order = np.lexsort((h, row))
        same = (h[order][1:] == h[order][:-1]) & (row[order][1:] == row[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        edge = np.zeros(len(w.doc) + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + size, -1)
        repeated = per_row(w.doc[np.cumsum(edge[:-1]) > 0], rows)

    # lines: a text ends a line, and so does every line feed
    breaks = np.flatnonzero(data == 0x0A)
    l_start = np.unique(np.concatenate([span[:-1], breaks + 1]))
    l_start = l_start[l_start < len(data)]
    l_row = np.searchsorted(span, l_start, side="right") - 1
    l_end = np.minimum(np.append(l_start[1:], len(data)), span[l_row + 1])
    l_stop = l_end - ((l_end > l_start) & (data[np.maximum(l_end - 1, 0)] == 0x0A))
    first, last = np.searchsorted(w.start, l_start), np.searchsorted(w.start, l_stop)
    worded = last > first
    l_start, l_stop, l_row, first, last = (x[worded] for x in (l_start, l_stop, l_row, first, last))
    again = _equal_earlier(l_row, run_hash(w.sums, l_start, l_stop, BYTE_BASE)) if len(l_row) else np.zeros(0, bool)
    n_dup = per_row(l_row[again], rows)
    l_words, l_chars = last - first, chars[l_stop] - chars[l_start]
    l_symbols, l_shouts = symbols[l_stop] - symbols[l_start], shouts[l_stop] - shouts[l_start]
    l_marks = marks[l_stop] - marks[l_start]
    fails = (
        again
        | (l_symbols > rules.symbol_share * l_chars)
        | (l_shouts > rules.shout_share * l_words)
        | (l_words > rules.open_words * (l_marks + 1))
    )
    fails |= _menus(l_row, (l_words <= rules.menu_words) & (l_marks == 0), rules.menu_lines)
    if rules.phrases and len(l_row):
        pattern = re.compile(rb"(?<![0-9A-Za-z])(?:" + "|".join(map(re.escape, rules.phrases)).encode() + rb")(?![0-9A-Za-z])", re.IGNORECASE)
        found = np.array([m.span() for m in pattern.finditer(data.tobytes())], np.int64).reshape(-1, 2)
        line = np.searchsorted(l_start, found[:, 0], side="right") - 1
        good = line >= 0
        good[good] = found[good, 0] < l_stop[line[good]]
        stock = chars[found[good, 1]] - chars[found[good, 0]]  # characters of the phrases' words
        fails |= per_row(line[good], len(l_row), stock) > np.maximum(rules.phrase_share * l_chars - 1e-9, 0)
    lost = per_row(l_row[fails], rows, l_chars[fails])
    share = lost / np.maximum(word_chars, 1)
    base_failed = (n < rules.min_words) | (100 * repeated > rules.repeat_percent * n)
    kept = ~base_failed & (share <= rules.lost_share)
    clean = [None] * rows
    if with_text:
        pieces: list[list[bytes]] = [[] for _ in range(rows)]
        body = data.tobytes()
        for r, a, b in zip(l_row[~fails].tolist(), l_start[~fails].tolist(), l_stop[~fails].tolist()):
            pieces[r].append(body[a:b])
        clean = [b"\n".join(p).decode("utf-8", "replace") for p in pieces]
    columns = [part.column(c) for c in keep] + [
        pa.array(x)
        for x in (n, word_chars, n_symbols, n_dup, repeated, base_failed, kept, per_row(l_row, rows), per_row(l_row[fails], rows), share)
    ]
    names = keep + [c.split()[0] for c in OUTPUT.split(", ")]
    return pa.RecordBatch.from_arrays([*columns, pa.array(clean, pa.string())], names=names)


def clean_lines(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rules: LineRules = LineRules(), with_text: bool = True
) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, statistics, the verdict ``kept`` and
    ``clean_text`` (the lines that passed).

    A null or empty text has no words, fails the base rule and is not kept.  Repeated rows give
    repeated results.  An empty table gives an empty result.  Columns outside ``keep`` are not
    read, so their names cannot clash; a name in ``keep`` that equals an output column is refused.
    """
    ours = {c.split()[0] for c in OUTPUT.split(", ")}
    if clash := ours & set(keep):
        raise ValueError(f"columns to keep have names of the result: {sorted(clash)}")
    columns = list(dict.fromkeys((*keep, text)))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [OUTPUT])
    names = list(keep)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return _clean(part, text, rules, names, with_text)

    return docs.select(*columns).mapInArrow(by_slices(run, text), schema)
