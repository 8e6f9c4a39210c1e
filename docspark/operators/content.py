"""Content typing by scores, column detection, and merging of native and recognised page text."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.parts import bounds
from docspark.plans.fixtures import load
from docspark.registry import query

c = F.col
#: Fixed patterns and keywords of the scores.
TABLE = (r"(?m)\|.*\|.*\|", r"(?m)^\s*\w+\s+\w+\s+\w+\s*$", r"(?m)^\s*[-\s]+$", r"(?i)\btable\s+\d+")
CHART, CHART_WORDS = (r"(?i)\bchart\s*\d*", r"(?i)\bfigure\s*\d*", r"(?i)\bgraph\s*\d*"), ("legend", "axis", "plot", "data", "series", "x-axis", "y-axis")
HEADER = (r"(?m)^[A-Z\s]{3,50}$", r"(?m)^\d+\.\s+[A-Z]", r"(?i)^Chapter\s+\d+")
LIST = r"^\s*[•·▪▫]\s+|^\s*\d+\.\s+|^\s*[a-z]\)\s+"
SYMBOLS = ("=", "+", "-", "×", "÷", "√", "∑", "∫", "^", "²", "³")


def _sum(tests: list[tuple[Column, float]]) -> Column:
    total = F.lit(0.0)
    for test, value in tests:
        total = total + F.when(test, value).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def aligned_columns(t: Column, tolerance: int = 5) -> Column:
    """Whether, of three lines or more, one of the second to fifth has its wide gaps where the first has."""

    @F.arrow_udf("boolean")
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            lines = (text or "").split("\n")
            gaps = [[m.start() for m in re.finditer(r"\s{2,}", x)] for x in lines[:5]]
            out.append(len(lines) >= 3 and any(len(g) == len(gaps[0]) and all(abs(a - b) <= tolerance for a, b in zip(g, gaps[0], strict=True)) for g in gaps[1:]))
        return pa.array(out, pa.bool_())

    return run(t)


def content_type(t: Column) -> Column:
    """A struct (type, confidence): the first score over its bar, else a paragraph at 0.9."""
    lines = F.split(t, "\n")
    n = F.size(lines)
    table = _sum([*((t.rlike(p), 0.3) for p in TABLE), (aligned_columns(t), 0.4), (F.size(F.filter(lines, lambda x: x.rlike(r"\d+.*\d+.*\d+"))) >= 2, 0.3)])
    chart = _sum([*((t.rlike(p), 0.5) for p in CHART), *((F.contains(F.lower(t), F.lit(w)), 0.1) for w in CHART_WORDS)])
    shouting = (F.upper(t) == t) & (F.lower(t) != t)
    header = _sum([((F.length(t) < 100) & (n <= 2), 0.4), *((t.rlike(p), 0.3) for p in HEADER), (shouting & (F.length(t) < 50), 0.4)])
    items = F.size(F.filter(lines, lambda x: x.rlike(LIST)))
    listed = _sum([(items >= 2, 0.6), ((items == 1) & (n <= 3), 0.4)])
    symbols = F.size(F.filter(F.array(*map(F.lit, SYMBOLS)), lambda x: F.contains(t, x)))
    equation = _sum([(symbols >= 3, 0.5), ((symbols.between(1, 2)) & (F.length(t) < 100), 0.3), (t.rlike(r"\w+\s*=\s*\w+"), 0.3)])
    kind = lambda name, score: F.struct(F.lit(name).alias("type"), score.alias("confidence"))
    out = kind("PARAGRAPH", F.lit(0.9))
    for name, score, bar in (("EQUATION", equation, 0.8), ("LIST", listed, 0.7), ("HEADER", header, 0.8), ("CHART", chart, 0.7), ("TABLE", table, 0.6)):
        out = F.when(score > bar, kind(name, score)).otherwise(out)
    return out


def content_info(t: Column) -> Column:
    """Rows and columns that a table would have, a chart's title, the number of list items."""
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "")
    first = F.try_element_at(F.split(t, "\n"), F.lit(1))
    title = F.when(F.lower(first).rlike("figure|chart|graph"), F.trim(first))
    return F.struct(F.size(lines).alias("rows"), (F.size(F.split(F.try_element_at(lines, F.lit(1)), r"\s{2,}|\|")) - 0).alias("columns"), title.alias("title"), F.size(F.filter(F.split(t, "\n"), lambda x: x.rlike(LIST))).alias("items"))


def best_cuts(x: np.ndarray, k: int) -> list[int]:
    """Where sorted numbers are cut in ``k`` runs with the least sum of squared distances to the runs' means, exactly: the best last run of
    each prefix, by dynamic programming. Ties (to six places) go to the smallest last cut."""
    n = len(x)
    sums, squares = np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(x * x)]
    cost = lambda i, j: squares[j] - squares[i] - (sums[j] - sums[i]) ** 2 / np.maximum(j - i, 1)
    best, cuts = cost(0, np.arange(n + 1)), []
    for parts in range(2, k + 1):
        last, at = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        for j in range(parts, n + 1):
            i = np.arange(parts - 1, j)
            total = np.round(best[i] + cost(i, j), 6)
            at[j] = i[total.argmin()]
            last[j] = best[at[j]] + cost(at[j], j)
        best = last
        cuts.append(at)
    found, end = [], n
    for at in reversed(cuts):
        end = int(at[end])
        found.insert(0, end)
    return found


def columns_of(mids: list[float], width: float, most: int = 3, gap: float = 0.2) -> list[int]:
    """The column of each block, from 0 on the left: as many runs of their middles as there can be, ``most`` at most, whose means lie at least
    ``gap`` of the width apart."""
    x = np.array(mids, dtype=float)
    order = np.argsort(x, kind="stable")
    for k in range(min(most, len(x)), 1, -1):
        ends = [0, *best_cuts(x[order], k), len(x)]
        means = [x[order][a:b].mean() for a, b in zip(ends, ends[1:], strict=False)]
        if min(np.diff(means)) >= gap * width:
            out = np.zeros(len(x), dtype=int)
            out[order] = np.repeat(np.arange(k), np.diff(ends))
            return out.tolist()
    return [0] * len(x)


def columns_of_all(mids: pa.Array, widths: np.ndarray, most: int = 3, gap: float = 0.2) -> list[np.ndarray]:
    """``columns_of`` the lists of an array, those of one length together."""
    sizes = pc.fill_null(pc.list_value_length(mids), 0).to_numpy(zero_copy_only=False)
    flat, starts = mids.flatten().to_numpy(zero_copy_only=False).astype(float), np.r_[0, np.cumsum(sizes)[:-1]]
    out: list[np.ndarray] = [np.zeros(0, dtype=int)] * len(sizes)
    for n in np.unique(sizes[sizes > 0]).tolist():
        for at in np.array_split(np.flatnonzero(sizes == n), max(1, int(n * np.count_nonzero(sizes == n)) >> 18)):
            x = flat[starts[at][:, None] + np.arange(n)]
            order = np.argsort(x, axis=1, kind="stable")
            x, found, open_ = np.take_along_axis(x, order, axis=1), np.zeros((len(at), n), dtype=int), np.arange(len(at))
            for k in range(min(most, n), 1, -1):
                y = x[open_]
                ends = np.c_[np.zeros(len(y), dtype=int), _best_cuts_of_all(y, k), np.full(len(y), n)]
                sums = np.c_[np.zeros(len(y)), np.cumsum(y, axis=1)]
                means = np.diff(np.take_along_axis(sums, ends, axis=1), axis=1) / np.diff(ends, axis=1)
                good = np.diff(means, axis=1).min(axis=1) >= gap * widths[at][open_]
                label = (np.arange(n)[None, :, None] >= ends[good][:, None, 1:-1]).sum(axis=2)
                np.put_along_axis(whole := np.zeros((good.sum(), n), dtype=int), order[open_[good]], label, axis=1)
                found[open_[good]] = whole
                open_ = open_[~good]
                if not len(open_):
                    break
            for row, page in enumerate(at.tolist()):
                out[page] = found[row]
    return out


def _best_cuts_of_all(x: np.ndarray, k: int) -> np.ndarray:
    """``best_cuts`` of rows of sorted numbers."""
    rows, n = x.shape
    sums, squares = (np.c_[np.zeros(rows), np.cumsum(v, axis=1)] for v in (x, x * x))
    cost = lambda i, j: squares[:, j] - squares[:, i] - (sums[:, j] - sums[:, i]) ** 2 / np.maximum(j - i, 1)
    best, cuts, every = cost(np.zeros(n + 1, dtype=int), np.arange(n + 1)), [], np.arange(rows)
    for parts in range(2, k + 1):
        last, at = np.full((rows, n + 1), np.inf), np.zeros((rows, n + 1), dtype=int)
        for j in range(parts, n + 1):
            i = np.arange(parts - 1, j)
            of = cost(i, np.full(len(i), j))
            chosen = np.round(best[:, i] + of, 6).argmin(axis=1)
            at[:, j] = i[chosen]
            last[:, j] = best[every, at[:, j]] + of[every, chosen]
        best = last
        cuts.append(at)
    found, end = [], np.full(rows, n)
    for at in reversed(cuts):
        end = at[every, end]
        found.insert(0, end)
    return np.stack(found, axis=1)


def count_columns(mids: Column, width: Column, most: int = 3, gap: float = 0.2) -> Column:
    """The number of text columns of a page from the middles of its blocks, see ``columns_of``; one where there are none."""

    @F.arrow_udf("int")
    def run(lists: pa.Array, widths: pa.Array) -> pa.Array:
        found = columns_of_all(lists, widths.to_numpy(zero_copy_only=False).astype(float), most, gap)
        return pa.array([int(x.max(initial=0)) + 1 for x in found], pa.int32())

    return run(mids, width)


def column_text(blocks: Column, most: int = 3, gap: float = 0.2) -> Column:
    """The text of a page from its blocks, an array of structs (x0, y0, x1, y1, text): column by column from the left, each from the top;
    blocks without text go. The page's width is that of its blocks. Empty for null."""

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        out = []
        for start, end in bounds(pc.fill_null(pc.list_value_length(pages), 0).to_pylist(), 1 << 14):
            held = [[b | {"text": b["text"].strip()} for b in page or () if b and (b["text"] or "").strip()] for page in pages[start:end].to_pylist()]
            widths = np.array([max((b["x1"] for b in page), default=0) - min((b["x0"] for b in page), default=0) for page in held], dtype=float)
            mids = pa.array([[(b["x0"] + b["x1"]) / 2 for b in page] for page in held], pa.list_(pa.float64()))
            for page, at in zip(held, columns_of_all(mids, widths, most, gap), strict=True):
                columns: list[list[dict]] = [[] for _ in range(int(at.max(initial=0)) + 1)]
                for b, k in zip(page, at.tolist(), strict=True):
                    columns[k].append(b)
                out.append("\n\n".join("\n".join(b["text"] for b in sorted(column, key=lambda b: b["y0"])) for column in columns).strip())
        return pa.array(out, pa.string())

    return run(blocks)


def merge_page_text(native: Column, recognised: Column, threshold: float = 0.85) -> Column:
    """Native paragraphs, then recognised ones that are like none of them; of those only lines that are like
    no native line; each line once, whatever its case."""

    @F.arrow_udf("string")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        alike = lambda x, y: SequenceMatcher(None, x.lower(), y.lower()).ratio() > threshold
        parts = lambda t, cut: [p for q in t.split(cut) if (p := q.strip())]
        out = []
        for own, other in zip(a.to_pylist(), b.to_pylist(), strict=True):
            if not own or not other:
                out.append(own or other or "")
                continue
            kept, lines = parts(own, "\n\n"), parts(own, "\n")
            for paragraph in parts(other, "\n\n"):
                if not any(alike(paragraph, k) for k in kept):
                    kept += [x for x in parts(paragraph, "\n") if not any(alike(x, y) for y in lines)]
            once: dict[str, str] = {}
            for line in (x for k in kept for x in parts(k, "\n")):
                once.setdefault(line.lower(), line)
            out.append("\n".join(once.values()))
        return pa.array(out, pa.string())

    return run(native, recognised)


# --- queries ---------------------------------------------------------------------------------------------


def _case_sum(tests: list[tuple[str, float]]) -> str:
    return "least(1.0::DOUBLE, 0.0::DOUBLE" + "".join(f" + CASE WHEN {test} THEN {value}::DOUBLE ELSE 0.0::DOUBLE END" for test, value in tests) + ")"


_HAS = lambda pattern: f"regexp_matches(text, '{pattern}')"
_GAPS = r"""list_transform(ls[1:5], lambda x: list_transform(range(1, len(regexp_extract_all(x, '\s{2,}')) + 1), lambda i:
  list_sum(list_transform(regexp_split_to_array(x, '\s{2,}')[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(regexp_extract_all(x, '\s{2,}')[1:i - 1], lambda p: length(p))), 0)))"""
_ALIGNED = """len(ls) >= 3 AND len(list_filter(gs[2:], lambda g: len(g) = len(gs[1]) AND len(list_filter(list_zip(g, gs[1]), lambda z: abs(z[1] - z[2]) > 5)) = 0)) > 0"""
_SCORES = {
    "table_score": [*((_HAS(p), 0.3) for p in TABLE), (_ALIGNED, 0.4), (r"len(list_filter(ls, lambda x: regexp_matches(x, '\d+.*\d+.*\d+'))) >= 2", 0.3)],
    "chart_score": [*((_HAS(p), 0.5) for p in CHART), *((f"contains(lower(text), '{w}')", 0.1) for w in CHART_WORDS)],
    "header_score": [("length(text) < 100 AND len(ls) <= 2", 0.4), *((_HAS(p), 0.3) for p in HEADER), ("upper(text) = text AND lower(text) <> text AND length(text) < 50", 0.4)],
    "list_score": [("items >= 2", 0.6), ("items = 1 AND len(ls) <= 3", 0.4)],
    "equation_score": [("symbols >= 3", 0.5), ("symbols BETWEEN 1 AND 2 AND length(text) < 100", 0.3), (_HAS(r"\w+\s*=\s*\w+"), 0.3)],
}
_TYPES_SQL = f"""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
g AS (SELECT *, {_GAPS} AS gs, len(list_filter(ls, lambda x: regexp_matches(x, '{LIST}'))) AS items, len(list_filter({list(SYMBOLS)}, lambda x: contains(text, x))) AS symbols FROM l),
s AS (SELECT doc_id, {", ".join(f"{_case_sum(tests)} AS {name}" for name, tests in _SCORES.items())} FROM g),
k AS (SELECT doc_id, CASE WHEN table_score > 0.6::DOUBLE THEN ('TABLE', table_score) WHEN chart_score > 0.7::DOUBLE THEN ('CHART', chart_score) WHEN header_score > 0.8::DOUBLE THEN ('HEADER', header_score)
  WHEN list_score > 0.7::DOUBLE THEN ('LIST', list_score) WHEN equation_score > 0.8::DOUBLE THEN ('EQUATION', equation_score) ELSE ('PARAGRAPH', 0.9::DOUBLE) END AS x FROM s)
SELECT doc_id, x[1] AS type, round(x[2], 6) AS confidence FROM k"""


@query("typing_content_types", _TYPES_SQL)
def _(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id", content_type(c("text")).alias("x")).select("doc_id", "x.type", F.round("x.confidence", 6).alias("confidence"))


@query("typing_content_info", rf"""SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INT AS n_rows, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{LIST}')))::INT AS items FROM documents""")
def _(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id", content_info(c("text")).alias("x")).select("doc_id", c("x.rows").alias("n_rows"), "x.items")


#: All cuts of a page's middles in two and three runs, with their costs and the least gap of their means.
_CUTS = """pages AS (SELECT l_orderkey, l_linenumber, ((l_partkey % 600) + 0.0)::DOUBLE AS mid, l_linenumber::DOUBLE AS y FROM lineitem),
x AS (SELECT l_orderkey, list(mid ORDER BY mid) AS xs, count(*)::INT AS n FROM pages GROUP BY 1),
c AS (SELECT l_orderkey, xs, n, 2 AS k, 0 AS i, unnest(range(1, n)) AS j FROM x WHERE n > 1 UNION ALL
  SELECT l_orderkey, xs, n, 3, i, unnest(range(i + 1, n)) FROM (SELECT *, unnest(range(1, n - 1)) AS i FROM x WHERE n > 2)),
r AS (SELECT l_orderkey, k, i, j, CASE WHEN k = 2 THEN [xs[1:j], xs[j + 1:]] ELSE [xs[1:i], xs[i + 1:j], xs[j + 1:]] END AS rs FROM c),
m AS (SELECT l_orderkey, k, i, j, rs, list_transform(rs, lambda r: list_avg(r)) AS means, list_sum(list_transform(rs, lambda r: list_sum(list_transform(r, lambda v: v * v)) - list_sum(r) * list_sum(r) / len(r))) AS cost FROM r),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY l_orderkey, k ORDER BY round(cost, 6), j, i) = 1),
good AS (SELECT l_orderkey, k, means, rs, list_min(list_transform(range(1, k), lambda t: means[t + 1] - means[t])) AS gap FROM best)"""


@query("typing_columns", f"""WITH {_CUTS} SELECT l_orderkey, coalesce(max(k) FILTER (gap >= 120.0), 1)::INT AS n_columns FROM x LEFT JOIN good USING (l_orderkey) GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Pages stand in by orders, block middles by part keys."""
    pages = load(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list((c("l_partkey") % 600).cast("double")).alias("mids"))
    return pages.select("l_orderkey", count_columns(c("mids"), F.lit(600.0)).alias("n_columns"))


@query("typing_column_text", f"""WITH {_CUTS.replace("((l_partkey % 600) + 0.0)::DOUBLE AS mid", "((l_partkey % 600) + l_linenumber / 64)::DOUBLE AS mid")}, w AS (SELECT l_orderkey, max(mid) + 10 - (min(mid) - 10) AS width FROM pages GROUP BY 1),
chosen AS (SELECT l_orderkey, arg_max(rs, k) AS rs FROM good JOIN w USING (l_orderkey) WHERE gap >= 0.2 * width GROUP BY 1),
placed AS (SELECT p.l_orderkey, p.y, 'b' || p.l_linenumber AS t, CASE WHEN rs IS NULL THEN 1 ELSE list_position(list_transform(rs, lambda r: list_contains(r, mid)), TRUE) END AS col FROM pages p LEFT JOIN chosen USING (l_orderkey)),
cols AS (SELECT l_orderkey, col, string_agg(t, chr(10) ORDER BY y) AS t FROM placed GROUP BY 1, 2)
SELECT l_orderkey, string_agg(t, chr(10) || chr(10) ORDER BY col) AS text FROM cols GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Pages stand in by orders; a line of an order is a block, placed by its part and its number."""
    mid = c("l_partkey") % 600 + c("l_linenumber") / 64
    block = F.struct((mid - 10).alias("x0"), c("l_linenumber").cast("double").alias("y0"), (mid + 10).alias("x1"), (c("l_linenumber") + 0.5).alias("y1"), F.concat(F.lit(" b"), c("l_linenumber").cast("string")).alias("text"))
    pages = load(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(block).alias("blocks"))
    return pages.select("l_orderkey", column_text(c("blocks")).alias("text"))


@query("typing_merge_page_text")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", F.md5(merge_page_text(c("text"), F.concat(F.substring("text", 1, 80), F.lit("\n\nrecognised only\nOther")))).alias("merged_md5"))
