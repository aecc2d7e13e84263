"""Tables out of plain lines: the block before a caption, its columns and its rows.

Lines of a document pass through one task in their order, with the last ``lookback`` of them at hand; so a document may
be of any length. Spark deals documents by id and sorts their lines.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Captions, numbers, and words that make one name of two.
TABLE_CAPTION = re.compile(r"^\s*table\s*(s?\d+|[ivxlcdm]+)\s*[\.:]?\s+.*$", re.IGNORECASE)
FIGURE_CAPTION = re.compile(r"^\s*fig(?:ure|\.)?\s*\d+", re.IGNORECASE)
NUMBER = re.compile(r"^[+-]?\d+(\.\d+)?\s*%?(\s*±\s*\d+(\.\d+)?)?$")
MODIFIERS = frozenset("middle south southeast north east west central latin sub".split())
SUFFIXES = frozenset("eastern asian african american european islander latino hispanic".split())


def is_number(x: str) -> bool:
    return bool(NUMBER.match(x.strip()))


def is_paragraph(line: str) -> bool:
    """A line of running text: eight words or more, most of them without digits, in 60 characters or more."""
    words = line.split()
    return len(line) >= 60 and len(words) >= 8 and 2 * sum(w.strip(".,;:()").isalpha() for w in words) > len(words)


def block_before(lines: list[str]) -> list[str]:
    """The lines of a table that ends where ``lines`` end. Going back it stops before two blank lines, another caption, two
    lines of running text, a long one, or any once there are more than three lines; and at a blank line under running
    text once there are five."""
    block: list[str] = []
    blank = prose = 0
    for at in range(len(lines) - 1, -1, -1):
        line = lines[at].strip()
        if not line:
            blank += 1
            if blank == 2 or (len(block) >= 5 and at and is_paragraph(lines[at - 1].strip())):
                break
            continue
        blank = 0
        if FIGURE_CAPTION.match(line) or TABLE_CAPTION.match(line):
            break
        prose = prose + 1 if is_paragraph(line) else 0
        if prose and (prose == 2 or len(line) > 100 or len(block) > 3):
            break
        block.append(line)
    return block[::-1]


def width(parts: list[str]) -> int | None:
    """The most frequent length, two or more, of a run of numbers behind something else (the first seen of several)."""
    runs: Counter = Counter()
    behind = False
    for number, group in itertools.groupby(parts, is_number):
        n = len(list(group))
        if number and behind and n >= 2:
            runs[n] += 1
        behind = behind or not number
    return max(runs, key=runs.get) if runs else None


def values_per_row(lines: list[str]) -> int | None:
    """By lines; where no line alone tells, by the words of each."""
    if found := width(lines):
        return found
    counts: Counter = Counter()
    for line in lines:
        if found := width(line.split()):
            counts[found] += 1
    return max(counts, key=counts.get) if counts else None


def groups(line: str, n: int):
    """(label, numbers) in a line: words up to a number, and at most ``n`` numbers; what is no label and no such number is passed
    over. The last may lack numbers, others are whole."""
    words = line.split()
    at = 0
    while at < len(words):
        lo = at
        while at < len(words) and not is_number(words[at]):
            at += 1
        hi = at
        while at < len(words) and at - hi < n and is_number(words[at]):
            at += 1
        if hi > lo and (at - hi == n or (at > hi and at == len(words))):
            yield " ".join(words[lo:hi]), words[hi:at]
        while at < len(words) and is_number(words[at]):
            at += 1


def stacked(lines: list[str], at: int, n: int) -> bool:
    """Whether a label stands here with its ``n`` numbers on the next lines."""
    return at + n < len(lines) and not is_number(lines[at]) and all(map(is_number, lines[at + 1 : at + 1 + n]))


def first_row(lines: list[str], n: int) -> int | None:
    for at in range(len(lines)):
        if stacked(lines, at, n):
            return at
    return next((at for at, line in enumerate(lines) if any(len(v) == n for _, v in groups(line, n))), None)


def rows_of(lines: list[str], n: int) -> list[list[str]]:
    out, at = [], 0
    while at < len(lines):
        inline = [[label, *numbers] for label, numbers in groups(lines[at], n)]
        if inline:
            out += inline
        elif stacked(lines, at, n):
            out.append(lines[at : at + 1 + n])
            at += n
        at += 1
    return out


def merged_words(words: list[str], most: int) -> list[str]:
    """Words as names: pairs that belong together are joined, and what is too many goes to the last name."""
    if len(words) <= most:
        return words
    names: list[str] = []
    for w in words:
        paired = names and names[-1].lower() in MODIFIERS and w.lower() in SUFFIXES
        if paired:
            names[-1] += " " + w
        else:
            names.append(w)
    return [*names[: most - 1], " ".join(names[most - 1 :])] if len(names) > most else names


def spread(lines: list[str], places: int) -> list[str]:
    """Header lines dealt in order over so many columns; the first ones get one more where it doesn't come out even."""
    each, more = divmod(len(lines), places)
    ends = list(itertools.accumulate([each + (i < more) for i in range(places)], initial=0))
    return [" ".join(lines[a:b]) for a, b in itertools.pairwise(ends)]


def header_names(lines: list[str], columns: int) -> list[str]:
    """As many names as columns. The first column, of labels, has none unless there are names for all."""
    places = columns - 1
    if len(lines) > columns:
        short = all(len(h) < 30 for h in lines) and len(lines) >= 1.5 * columns
        return ["", *spread(lines, places)] if short else [*lines[:places], " ".join(lines[places:])]
    if len(lines) == columns:
        return lines
    words = lines[0].split() if len(lines) == 1 else []
    if len(words) >= columns and columns > 1:
        names = merged_words(words, columns)
        names = ["", *names] if len(names) == places else names
    elif len(words) >= places and len(lines) != places:
        names = ["", *merged_words(words, places)]
    else:
        names = ["", *lines]
    return names + [f"col{i}" for i in range(len(names), columns)]


def column_name(x: str) -> str:
    x = x.strip().lower()
    return re.sub(r"[^a-z0-9]+", "_", x).strip("_") or "col" if x else ""


def column_names(lines: list[str], columns: int, caption: str) -> list[str]:
    """Names in snake case, unlike each other; under a caption of top-1 values those of numbers say so."""
    names = [column_name(h) for h in header_names(lines, columns)]
    if re.search(r"\btop-?1\b", caption, re.IGNORECASE):
        names = names[:1] + [c if c.endswith("_top1") else f"{c}_top1" for c in names[1:]]
    seen: Counter = Counter()
    for i, c in enumerate(names):
        seen[c] += 1
        if seen[c] > 1:
            names[i] = f"{c}_{seen[c]}"
    return names


def parse(block: list[str], caption: str) -> tuple[list[str], list[list[str]]]:
    """Columns and rows. Without numbers in rows, lines are parted at wide blanks; without those the first 30 lines are one cell."""
    lines = [part.strip() for line in block for part in line.splitlines() if part.strip()]
    n = values_per_row(lines)
    if n is None:
        parted = [p for p in (re.split(r"\s{2,}", x) for x in lines) if len(p) >= 2]
        most = max(map(len, parted), default=0)
        if parted:
            return [f"col{i + 1}" for i in range(most)], [p + [""] * (most - len(p)) for p in parted]
    first = None if n is None else first_row(lines, n)
    if first is None:
        return ["col1"], [[" ".join(lines[:30])]]
    return column_names(lines[:first], n + 1, caption), rows_of(lines[first:], n)


def tables(lines: DataFrame, lookback: int = 220) -> DataFrame:
    """``doc``, ``n``, ``caption``, ``columns``, ``rows`` of each table, from lines (``doc``, ``n``, ``line``).

    ``n`` is the caption's line. Null lines are blank ones; lines of one number are ordered by their text; a caption with no
    lines before it has one empty cell; documents without captions, and empty tables, give no rows; further columns
    are not read.
    """
    told = lines.select("doc", F.col("n").cast("long").alias("n"), F.coalesce("line", F.lit("")).alias("line"))
    kind = told.schema["doc"].dataType.simpleString()

    def run(frames):
        doc, last = None, deque(maxlen=lookback)
        for pdf in frames:
            out = []
            for d, n, line in zip(pdf["doc"], pdf["n"], pdf["line"], strict=True):
                if d != doc:
                    doc, last = d, deque(maxlen=lookback)
                if TABLE_CAPTION.match(line):
                    out.append((d, n, line.strip(), *parse(block_before(list(last)), line)))
                last.append(line)
            yield pd.DataFrame(out, columns=["doc", "n", "caption", "columns", "rows"])

    ordered = told.where("doc is not null and n is not null").repartition("doc").sortWithinPartitions("doc", "n", "line")
    return ordered.mapInPandas(run, f"doc {kind}, n long, caption string, columns array<string>, rows array<array<string>>")


#: Words by which a line of short words or numbers still belongs to a caption.
CAPTION_WORDS = ["category", "classification", "accuracy", "images", "fairface", "percent"]


def paragraph(x: Column) -> Column:
    """``is_paragraph`` of a column."""
    words = F.split(F.trim(x), r"\s+")
    plain = F.filter(words, lambda w: F.regexp_replace(w, r"^[.,;:()]+|[.,;:()]+$", "").rlike(r"^\p{L}+$"))
    return (F.length(x) >= 60) & (F.size(words) >= 8) & (2 * F.size(plain) > F.size(words))


def table_data(x: Column) -> Column:
    """Whether a block holds a table's cells: ranges of numbers, many digits with separators, or five words and more that are mostly
    short or have digits and none of the words of a caption."""
    text = F.trim(x)
    words = F.split(text, r"\s+")
    ranges, numbers = F.regexp_count(text, F.lit(r"\d+-\d+")), F.size(F.filter(words, lambda w: w.rlike(r"^\d+\.?\d*$")))
    digits = F.regexp_count(text, F.lit(r"\d"))
    short = F.size(F.filter(words, lambda w: F.length(w) <= 8))
    known = F.lower(text).rlike("|".join(CAPTION_WORDS))
    many = (F.size(words) >= 5) & ((short > 0.6 * F.size(words)) | (digits > 0)) & ~known
    return (ranges >= 3) | ((ranges >= 1) & (numbers >= 3)) | ((digits > 0.3 * F.length(text)) & text.rlike("[|;\t]")) | many


def continued_captions(blocks: DataFrame, gap: float = 100.0) -> DataFrame:
    """``page``, ``block``, ``caption`` and ``n`` (blocks that belong to it) of the table captions among ``blocks`` (``page``, ``block``,
    ``x0``, ``y0``, ``x1``, ``y1``, ``text``; y grows downwards).

    A join by ranges finds what begins below a caption within two gaps: pages are cut in bands of that height, and a caption
    meets its own band and the next. Over the hits of a caption, from top to bottom, a fold takes what overlaps it
    horizontally (touching counts) until the next one is further than ``gap`` below the last taken, is a caption, running text or a
    table's data. Of a caption whose first sentence is followed by a long text that begins like one, the sentence stays.

    Blocks without coordinates are no hits, and captions without them stand alone; null texts are empty and never taken; of
    blocks of equal height the left one comes first; empty tables give no rows; further columns are not read.
    """
    told = blocks.select("page", "block", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")], F.coalesce("text", F.lit("")).alias("text"))
    band = lambda c: F.floor(F.col(c) / (2 * gap))
    captions = told.where(F.col("text").rlike("(?i)^\\s*table\\s*(s?\\d+|[ivxlcdm]+)\\s*[.:]?\\s+.*$"))
    zones = captions.select(F.col("page").alias("at"), F.col("block").alias("of"), F.col("x0").alias("cx0"), F.col("x1").alias("cx1"), F.col("y1").alias("bottom"), F.explode(F.array(band("y1"), band("y1") + 1)).alias("zone"))
    below = F.col("y0") - F.col("bottom")
    near = told.join(zones, (told["page"] == zones["at"]) & (band("y0") == F.col("zone"))).where((below > 0) & (below <= 2 * gap))
    over = (F.col("x1") >= F.col("cx0")) & (F.col("x0") <= F.col("cx1"))
    ends = F.col("text").rlike("(?i)^\\s*table\\s*(s?\\d+|[ivxlcdm]+)\\s*[.:]?\\s+.*$") | (over & (paragraph(F.col("text")) | ((F.trim("text") != "") & table_data(F.col("text")))))
    hit = F.struct("y0", "x0", "block", "y1", "text", over.alias("over"), ends.alias("ends"))
    hits = near.groupBy(F.col("at").alias("page"), F.col("of").alias("block")).agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    every = captions.join(hits, ["page", "block"], "left")

    def step(state, hit):
        stop = state["done"] | hit["ends"] | (hit["y0"] - state["bottom"] > gap)
        taken = ~stop & hit["over"] & (F.trim(hit["text"]) != "")
        return F.struct(
            F.when(taken, hit["y1"]).otherwise(state["bottom"]).alias("bottom"), stop.alias("done"),
            F.when(taken, F.concat(state["text"], F.lit(" "), hit["text"])).otherwise(state["text"]).alias("text"), (state["n"] + taken.cast("int")).alias("n"),
        )

    start = F.struct(F.col("y1").alias("bottom"), F.lit(False).alias("done"), F.col("text").alias("text"), F.lit(0).alias("n"))
    none = F.array().cast("array<struct<y0: double, x0: double, block: " + told.schema["block"].dataType.simpleString() + ", y1: double, text: string, over: boolean, ends: boolean>>")
    folded = every.withColumn("end", F.aggregate(F.coalesce("hits", none), start, step))
    whole = F.trim("end.text")
    cut = F.regexp_extract(whole, r"(?is)^(\s*table\s*(?:s?\d+|[ivxlcdm]+)\s*[.:]?\s+.*?[.!?])\s+(?-i:We|This|These|Our|In|To|It|ZS|Additionally)\b.{115,}$", 1)
    return folded.select("page", "block", F.when(cut != "", cut).otherwise(whole).alias("caption"), F.col("end.n").alias("n"))
