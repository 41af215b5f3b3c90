"""Writers. Files come from Spark's own committers, so a lost task leaves no half-written output."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = "\ufeff"


def nested(frame: DataFrame, group: list[str], order: str, columns: list[str], name: str) -> DataFrame:
    """One row per group with its rows as an ordered array of structs."""
    entry = F.struct(F.col(order).alias("__o"), *columns)
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda s: F.struct(*(s[c].alias(c) for c in columns)))
    return frame.groupBy(*group).agg(listed.alias(name))


def write_json(frame: DataFrame, path: str, pretty: bool = False, mode: str = "overwrite") -> None:
    """One JSON object per row; nulls are kept and other scripts written as they are."""
    options = {"ignoreNullFields": "false", "pretty": str(pretty).lower()}
    frame.select(F.to_json(F.struct("*"), options).alias("value")).write.mode(mode).text(path)


def append_audit(frame: DataFrame, path: str, secrets: tuple[str, ...] = ("api_key", "authorization")) -> None:
    """Append audit rows, without credentials."""
    frame.drop(*secrets).write.mode("append").json(path)


def joined_ids(ids: Column) -> Column:
    return F.array_join(ids, "|")


def write_csv(frame: DataFrame, path: str, columns: list[str]) -> None:
    """CSV in a fixed column order with a header and a byte-order mark; arrays are joined by ``|``.

    The mark is part of the first column's name, so every part file has it.
    """
    kinds = dict(frame.dtypes)
    shown = [joined_ids(F.col(c)) if kinds[c].startswith("array") else F.col(c) for c in columns]
    names = [BOM + columns[0], *columns[1:]]
    frame.select(*(s.alias(n) for s, n in zip(shown, names, strict=True))).write.mode("overwrite").option("header", True).csv(path)


def detector_labels(pages: DataFrame, annotations: DataFrame, page: str, image: str) -> DataFrame:
    """``image<TAB>JSON array`` per page, ``[]`` for a page without annotations. Columns: ord, transcription, points."""
    listed = nested(annotations, [page], "ord", ["transcription", "points"], "__l")
    value = F.coalesce(F.to_json("__l"), F.lit("[]"))
    return pages.join(listed, page, "left").select(F.concat(F.col(image), F.lit("\t"), value).alias("value"))


def write_vectors(frame: DataFrame, path: str, signature: str) -> None:
    """Vectors as Parquet with the signature of what they were made from in a column of its own folder."""
    frame.withColumn("signature", F.lit(signature)).write.mode("overwrite").partitionBy("signature").parquet(path)


def markdown(rows: list[dict], columns: list[str]) -> str:
    """A table of a few rows; missing values are ``?``."""
    line = lambda cells: "| " + " | ".join(cells) + " |"
    body = [line(["?" if r.get(c) is None else str(r[c]) for c in columns]) for r in rows]
    return "\n".join([line(columns), line(["---"] * len(columns)), *body])


def comparison(title: str, runs: DataFrame, expected: list[str], name: str, columns: list[str]) -> str:
    """A table of the expected runs in their order, ``?`` where one is missing or has no value, and the list of missing files.

    ``expected`` are the files that runs are stored in; there is a row for each.
    """
    found = {r[name]: r.asDict() for r in runs.filter(F.col(name).isin(expected)).select(name, *columns).collect()}  # one row a run
    rows = [found.get(e, {}) | {name: e} for e in expected]
    missing = [e for e in expected if e not in found]
    lines = [f"# {title}", "", markdown(rows, [name, *columns])]
    return "\n".join(lines + (["", "Missing files:", "", *(f"- `{e}`" for e in missing)] if missing else [])) + "\n"


def report(title: str, rows: list[dict], columns: list[str]) -> str:
    """An HTML table of a few rows, escaped."""
    cell = lambda tag, v: f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>"
    head = "".join(cell("th", c) for c in columns)
    body = "".join("<tr>" + "".join(cell("td", r.get(c)) for c in columns) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table><tr>{head}</tr>{body}</table>"
