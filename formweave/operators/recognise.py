"""Recognisers: pages to lines through registered engines, and words to lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from importlib.util import find_spec

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import LINES
from .layout import in_order

#: name -> (function from a page's row to [(text, x1, y1, x2, y2, confidence)], modules it needs, least confidence)
ENGINES: dict[str, tuple[Callable[[dict], Iterable[tuple]], tuple[str, ...], float]] = {}


def register_engine(name: str, needs: tuple[str, ...] = (), least: float = 0.3):
    def add(f):
        ENGINES[name] = (f, needs, least)
        return f

    return add


def available(name: str) -> bool:
    """KeyError for an engine nobody registered."""
    return all(find_spec(m) for m in ENGINES[name][1])


def recognise(pages: DataFrame, engine: str) -> DataFrame:
    """Lines of every page by an engine, in reading order, low confidences and blanks dropped."""
    f, needs, least = ENGINES[engine]
    if not available(engine):
        raise RuntimeError(f"{engine} needs {', '.join(needs)}")

    def run(frames):
        for frame in frames:
            rows = [(r["source"], r["page_index"], k, str(t).strip(), *map(float, box)) for r in frame.to_dict("records") for k, (t, *box) in enumerate(f(r)) if box[4] >= least and str(t).strip()]
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "line_no", "text", "x1", "y1", "x2", "y2", "confidence"])

    return in_order(pages.mapInPandas(run, LINES))


def words_to_lines(words: DataFrame, least: float = 0.0) -> DataFrame:
    """Tokens grouped by block, paragraph and line: mean confidence out of 100, box around all, texts in order.

    Blank tokens and those with a negative confidence are dropped, then lines under ``least``.
    """
    conf = F.col("conf").try_cast("double")
    w = words.where((F.trim("text") != "") & (conf >= 0)).withColumn("c", conf)
    keys = ["doc_id", "page_index", "block_num", "par_num", "line_num"]
    g = w.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ").alias("text"),
        F.min("left").cast("double").alias("x1"), F.min("top").cast("double").alias("y1"),
        F.max(F.col("left") + F.col("width")).cast("double").alias("x2"), F.max(F.col("top") + F.col("height")).cast("double").alias("y2"),
        (F.avg("c") / 100).alias("confidence"),
    )
    lines = g.where(F.col("confidence") >= least).withColumn("line_no", F.col("block_num") * 1_000_000 + F.col("par_num") * 1000 + F.col("line_num"))
    return in_order(lines.select("doc_id", "page_index", "line_no", "text", "x1", "y1", "x2", "y2", "confidence"))


def text_layer(words: DataFrame, scale: float = 1.0, least_chars: int = 50) -> DataFrame:
    """Lines of pages whose text layer has ``least_chars`` characters: words by block and line, left to right, confidence 1."""
    keys = ["doc_id", "page_index", "block_num", "line_num"]
    g = words.groupBy(*keys).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("left", "word_no", "text"))), lambda x: x["text"]), " ").alias("text"),
        *[(f(e) * scale).cast("double").alias(n) for n, f, e in (("x1", F.min, F.col("left")), ("y1", F.min, F.col("top")), ("x2", F.max, F.col("left") + F.col("width")), ("y2", F.max, F.col("top") + F.col("height")))],
    )
    pages = words.groupBy("doc_id", "page_index").agg(F.sum(F.length(F.trim("text"))).alias("n")).where(F.col("n") >= least_chars).select("doc_id", "page_index")
    lines = g.join(pages, ["doc_id", "page_index"]).withColumn("line_no", F.col("block_num") * 1000 + F.col("line_num")).withColumn("confidence", F.lit(1.0))
    return in_order(lines.select("doc_id", "page_index", "line_no", "text", "x1", "y1", "x2", "y2", "confidence"))


def detections_to_lines(raw: DataFrame, least: float = 0.3) -> DataFrame:
    """``(doc_id, page_index, items)``, items a JSON list of [polygon, text, score] or [polygon, [text, score]], possibly one level deeper.

    Malformed items are passed over, scores under ``least`` and blank texts dropped.
    """
    import json

    def run(frames):
        for f in frames:
            rows = []
            for d, p, items in zip(f.doc_id, f.page_index, f["items"]):
                try:
                    found = json.loads(items) if items else []
                except ValueError:
                    found = []
                if len(found) == 1 and isinstance(found[0], list) and found[0] and isinstance(found[0][0], list) and len(found[0][0]) and isinstance(found[0][0][0], list) and isinstance(found[0][0][0][0], list):
                    found = found[0]
                for k, item in enumerate(found):
                    try:
                        polygon, text, score = (item[0], *item[1]) if isinstance(item[1], list) else item[:3]
                        xs, ys = [float(q[0]) for q in polygon], [float(q[1]) for q in polygon]
                        if float(score) >= least and str(text).strip():
                            rows.append((d, p, k, str(text).strip(), min(xs), min(ys), max(xs), max(ys), float(score)))
                    except (TypeError, ValueError, IndexError):
                        continue
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "line_no", "text", "x1", "y1", "x2", "y2", "confidence"])

    return in_order(raw.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"), "items").mapInPandas(run, LINES))


def route(pages: DataFrame, layer: DataFrame, engine: str, use_text_layer: bool = True) -> DataFrame:
    """Lines from the text layer where a page has one and it may be used, else from the engine, which sees no other page."""
    if not use_text_layer:
        return recognise(pages, engine)
    have = layer.select(F.col("doc_id").alias("source"), "page_index").distinct()
    return layer.unionByName(recognise(pages.join(have, ["source", "page_index"], "left_anti"), engine))
