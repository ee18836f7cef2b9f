"""Positioned lines: nearest values, regions, rows and columns.

Everything is scoped by (doc_id, page_index), the key lines are partitioned by, so each operator is
one co-located self-join or one grouped fold.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import reading_order, vertical_overlap

PAGE = ["doc_id", "page_index"]
_LINE = ["line_no", "text", "x1", "y1", "x2", "y2", "confidence"]


def in_order(lines: DataFrame) -> DataFrame:
    """Lines with ``line_no`` in reading order within a page, from 0."""
    order = [*reading_order(F.col("y1"), F.col("x1")), F.col("line_no")]
    return lines.withColumn("line_no", (F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)) - 1).cast("int"))


def _beside(anchors: DataFrame, lines: DataFrame) -> DataFrame:
    other = lines.select(*PAGE, *[F.col(c).alias(f"v_{c}") for c in _LINE])
    return anchors.join(other, PAGE).where("line_no <> v_line_no")


def _nearest(pairs: DataFrame, keys: list[str], by: str) -> DataFrame:
    best = F.min(F.struct(by, "v_line_no", "v_text", "v_confidence")).alias("b")
    return pairs.groupBy(*keys).agg(best).select(*keys, F.col("b.v_line_no").alias("value_line"), F.col("b.v_text").alias("value"), F.col("b.v_confidence").alias("value_confidence"))


def value_right(anchors: DataFrame, lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The nearest line to the right of each anchor: overlap 0.4 or more, not left of its end by over half its height."""
    keys = keys or [*PAGE, "line_no"]
    over = vertical_overlap(F.col("y1"), F.col("y2"), F.col("v_y1"), F.col("v_y2")) >= 0.4
    return _nearest(_beside(anchors, lines).where(over & (F.col("v_x1") >= F.col("x2") - 0.5 * (F.col("y2") - F.col("y1")))), keys, "v_x1")


def value_below(anchors: DataFrame, lines: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The nearest line below each anchor: gap from -0.2 to 2.5 heights, left edges within 2.5 heights."""
    keys = keys or [*PAGE, "line_no"]
    h = F.col("y2") - F.col("y1")
    gap = F.col("v_y1") - F.col("y2")
    return _nearest(_beside(anchors, lines).where(gap.between(-0.2 * h, 2.5 * h) & (F.abs(F.col("v_x1") - F.col("x1")) <= 2.5 * h)), keys, "v_y1")


def in_region(lines: DataFrame, pages: DataFrame, region: tuple[float, float, float, float]) -> DataFrame:
    """Lines whose centre lies in a region given as fractions of ``pages(doc_id, page_index, width, height)``."""
    x, y = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    size = pages.select(*PAGE, F.col("width").alias("_w"), F.col("height").alias("_h"))
    inside = x.between(region[0] * F.col("_w"), region[2] * F.col("_w")) & y.between(region[1] * F.col("_h"), region[3] * F.col("_h"))
    return lines.join(size, PAGE).where(inside).drop("_w", "_h")


def merge(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of lines as one: texts joined in reading order, least confidence, box around all."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(reading_order(F.col("y1"), F.col("x1")))], "line_no", "text")
    return lines.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda s: s["text"]), " ").alias("text"),
        F.min("confidence").alias("confidence"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
    )


def gather(anchors: DataFrame, lines: DataFrame, max_below: int = 1) -> DataFrame:
    """For each anchor: the lines to its right and up to ``max_below`` lines below it, merged; a line that is both counts twice."""
    keys, h, gap = [*PAGE, "anchor"], F.col("y2") - F.col("y1"), F.col("v_y1") - F.col("y2")
    pairs = _beside(anchors, lines).withColumn("anchor", F.col("line_no"))
    over = vertical_overlap(F.col("y1"), F.col("y2"), F.col("v_y1"), F.col("v_y2")) >= 0.4
    right = pairs.where(over & (F.col("v_x1") >= F.col("x2") - 0.5 * h))
    below = pairs.where(gap.between(-0.2 * h, 2.5 * h) & (F.abs(F.col("v_x1") - F.col("x1")) <= 2.5 * h))
    below = below.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("v_y1", "v_line_no"))).where(F.col("_k") <= max_below).drop("_k")
    both = right.unionByName(below).select(*keys, *[F.col(f"v_{c}").alias(c) for c in _LINE])
    return merge(both, keys)


def cluster_rows(lines: DataFrame, keys: list[str], least: float = 0.3) -> DataFrame:
    """``row_no`` for each line: from the top, a line joins the row whose growing hull it overlaps, else starts one.

    The rule depends on the order, so each group is folded over its sorted array.
    """
    item = F.struct("y1", "x1", "line_no", "y2")
    start = F.struct(F.lit(-1).alias("row"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"), F.array().cast("array<struct<line_no:int,row_no:int>>").alias("out"))

    def step(acc, x):
        joins = (acc["row"] >= 0) & (vertical_overlap(acc["lo"], acc["hi"], x["y1"], x["y2"]) >= least)
        row = F.when(joins, acc["row"]).otherwise(acc["row"] + 1)
        lo, hi = F.when(joins, F.least(acc["lo"], x["y1"])).otherwise(x["y1"]), F.when(joins, F.greatest(acc["hi"], x["y2"])).otherwise(x["y2"])
        return F.struct(row.alias("row"), lo.alias("lo"), hi.alias("hi"), F.array_append(acc["out"], F.struct(x["line_no"].cast("int").alias("line_no"), row.cast("int").alias("row_no"))).alias("out"))

    g = lines.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    g = g.select(*keys, F.explode(F.aggregate("_items", start, step)["out"]).alias("o"))
    return g.select(*keys, "o.line_no", "o.row_no")


def assign_columns(cells: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """``col_no, col_name`` of the header nearest to each cell's centre, the first on a tie; ``headers`` is a small table per key."""
    h = headers.select(*keys, "col_no", "col_name", F.col("cx").alias("_hx"))
    pairs = cells.join(h, keys)
    best = F.min(F.struct(F.abs((F.col("x1") + F.col("x2")) / 2 - F.col("_hx")).alias("d"), "col_no", "col_name")).alias("b")
    return pairs.groupBy(*keys, *[c for c in cells.columns if c not in keys]).agg(best).select(*keys, *[c for c in cells.columns if c not in keys], "b.col_no", "b.col_name")


def extract_table(lines: DataFrame, columns: list[dict], stop_keywords: list[str] = (), key_field: str | None = None, threshold: float = 80.0) -> DataFrame:
    """``(doc_id, page_index, records JSON, n_rows, confidence)``: a table below located headers.

    ``columns``: {name, header: [labels]}. Headers are taken greedily in the order of the columns,
    each the best unused line by fuzzy ratio; under two of them a page has no table. Pages are
    independent and their size is that of a page, so each is one group.
    """
    import json

    from ..functions.fuzzy import ratio_of
    from ..functions.text import _folds

    table = str.maketrans(*_folds())
    fold = lambda t: " ".join(t.translate(table).lower().split()).strip(" :.…-")

    def run(key, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y1", "x1", "line_no"], kind="stable").reset_index(drop=True)
        keys, used, heads = [fold(t or "") for t in f.text], set(), []
        for c in columns:
            labels = [fold(x) for x in c.get("header") or [c["name"]]]
            score = [(max(ratio_of(k, x) for x in labels), -i) for i, k in enumerate(keys) if i not in used]
            if score and max(score)[0] >= threshold:
                i = -max(score)[1]
                used.add(i)
                heads.append((c["name"], f.loc[i]))
        empty = pd.DataFrame(columns=["doc_id", "page_index", "records", "n_rows", "confidence"])
        if len(heads) < 2:
            return empty
        heads.sort(key=lambda h: (h[1].x1 + h[1].x2) / 2)
        bottom, lo, hi = max(h.y2 for _, h in heads), min(h.x1 for _, h in heads), max(h.x2 for _, h in heads)
        cy, cx, margin = (f.y1 + f.y2) / 2, (f.x1 + f.x2) / 2, 0.5 * (hi - lo) / len(heads)
        stops = [y for y, k in zip(cy, keys) if y > bottom and any(fold(s) in k for s in stop_keywords)]
        body = f[(cy > bottom) & (cy < min(stops, default=float("inf"))) & (cx >= lo - margin) & (cx <= hi + margin)]
        rows, top, end = [], 0.0, 0.0
        for x in body.itertuples():
            small = min(end - top, x.y2 - x.y1) or 1.0
            if rows and max(0.0, min(end, x.y2) - max(top, x.y1)) / small >= 0.3:
                rows[-1].append(x)
                top, end = min(top, x.y1), max(end, x.y2)
            else:
                rows.append([x])
                top, end = x.y1, x.y2
        out, conf = [], []
        for r in rows:
            rec = {}
            for x in sorted(r, key=lambda x: x.x1):
                name = min(heads, key=lambda h: abs((h[1].x1 + h[1].x2) / 2 - (x.x1 + x.x2) / 2))[0]
                rec[name] = f"{rec[name]} {x.text}" if name in rec else x.text
            if any(rec.values()) and (not key_field or rec.get(key_field)):
                out.append(rec)
                conf.append(min(x.confidence for x in r))
        return pd.DataFrame([(*key, json.dumps(out, ensure_ascii=False), len(out), min(conf))], columns=empty.columns) if out else empty

    cols = ["doc_id", "page_index", "line_no", "text", "x1", "y1", "x2", "y2", "confidence"]
    kinds = dict(lines.dtypes)
    return lines.select(*cols).groupBy(*PAGE).applyInPandas(run, f"doc_id {kinds['doc_id']}, page_index {kinds['page_index']}, records string, n_rows int, confidence double")
