"""Readers; schemas are explicit, so that one child is read like many."""

from __future__ import annotations

import io
import struct
import xml.etree.ElementTree as tree
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from inkframe.functions.geometry import Box, polygon_bounds, rectangle

BOX = "_xmin:string, _ymin:string, _xmax:string, _ymax:string"
#: Most corners of a polygon that attributes x0, y0, x1, ... can give.
CORNERS = 64


def _book() -> Column:
    return F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.[^.]*$", 1)


def _pages(spark: SparkSession, path: str, children: str, strip: bool = True) -> DataFrame:
    schema = f"_index int, _width int, _height int, {children}"
    reader = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", str(strip).lower()).schema(schema)
    return reader.load(path).select(
        _book().alias("book"),
        F.col("_index").alias("page"),
        F.coalesce("_width", F.lit(0)).alias("width"),
        F.coalesce("_height", F.lit(0)).alias("height"),
        "*",
    )


def read_rectangles(spark: SparkSession, path: str) -> DataFrame:
    """Texts of pages: book, page, width, height, id, text, x1..y2 and polygon. Books are file names."""
    rows = _pages(spark, path, f"text array<struct<_id:string, {BOX}, _VALUE:string>>")
    flat = rows.select("book", "page", "width", "height", F.explode("text").alias("t"))
    named = flat.select(
        "book", "page", "width", "height", F.col("t._id").alias("id"), F.btrim(F.coalesce("t._VALUE", F.lit(""))).alias("text"),
        *(F.col(f"t._{s}").cast("double").alias(a) for s, a in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))),
    )
    return named.withColumn("polygon", rectangle(Box.of()))


def read_polygons(spark: SparkSession, path: str, element: str = "onomatopoeia", least: int = 3) -> DataFrame:
    """Polygon texts: corners up to the first missing one, without polygons of fewer than ``least``; x1..y2 are the extremes."""
    fields = ", ".join(["_id:string", "_VALUE:string", *(f"_{a}{i}:string" for i in range(CORNERS) for a in "xy")])
    rows = _pages(spark, path, f"{element} array<struct<{fields}>>")
    flat = rows.select("book", "page", "width", "height", F.explode(element).alias("t"))
    corners = F.array(*(F.struct(F.col(f"t._x{i}").cast("double").alias("x"), F.col(f"t._y{i}").cast("double").alias("y")) for i in range(CORNERS)))
    gap = F.array_min(F.filter(F.transform(corners, lambda p, i: F.when(p["x"].isNull() | p["y"].isNull(), i)), lambda i: i.isNotNull()))
    polygon = F.slice(corners, F.lit(1), F.coalesce(gap, F.lit(CORNERS)))
    named = flat.select("book", "page", "width", "height", F.col("t._id").alias("id"), F.btrim(F.coalesce("t._VALUE", F.lit(""))).alias("text"), polygon.alias("polygon"))
    kept = named.filter(F.size("polygon") >= least).withColumn("__b", polygon_bounds(F.col("polygon")))
    return kept.select("*", *(F.col(f"__b.{c}").alias(c) for c in ("x1", "y1", "x2", "y2"))).drop("__b")


def read_objects(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("face", "body", "frame")) -> DataFrame:
    """Faces, bodies and frames: book, page, cls, id, character_id and integer box."""
    fields = "_id:string, _character:string, _xmin:string, _ymin:string, _xmax:string, _ymax:string"
    rows = _pages(spark, path, ", ".join(f"{k} array<struct<{fields}>>" for k in kinds))
    out = None
    for kind in kinds:
        part = rows.select("book", "page", "width", "height", F.lit(kind).alias("cls"), F.explode(kind).alias("t"))
        out = part if out is None else out.unionByName(part)
    return out.select(
        "book", "page", "width", "height", "cls", F.col("t._id").alias("id"), F.col("t._character").alias("character_id"),
        *(F.coalesce(F.col(f"t._{s}").cast("double"), F.lit(0.0)).cast("int").alias(a) for s, a in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))),
    )


def read_character_names(spark: SparkSession, path: str) -> DataFrame:
    """book, character_id, name (empty if missing)."""
    rows = spark.read.format("xml").option("rowTag", "characters").schema("character array<struct<_id:string,_name:string>>").load(path)
    return rows.select(_book().alias("book"), F.explode("character").alias("c")).select("book", F.col("c._id").alias("character_id"), F.coalesce("c._name", F.lit("")).alias("name"))


def read_transcripts(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """book, page, id and the first text of each text element, white space kept. If strict, an id twice on a page is an error."""
    rows = _pages(spark, path, "text array<struct<_id:string,_VALUE:string>>", strip=False)
    flat = rows.select("book", "page", F.explode("text").alias("t")).select("book", "page", F.col("t._id").alias("id"), F.coalesce("t._VALUE", F.lit("")).alias("text"))
    if not strict:
        return flat
    again = F.count(F.lit(1)).over(Window.partitionBy("book", "page", "id")) > 1
    error = F.raise_error(F.concat(F.lit("duplicate id on a page: "), F.coalesce("id", F.lit("null")))).cast("string")
    return flat.withColumn("text", F.when(again, error).otherwise(F.col("text")))


def read_boxes(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("text", "body")) -> DataFrame:
    """book, page, cls, id and box of texts and bodies; a missing coordinate is 0, a missing page size 1."""
    schema = ", ".join(["_index int, _width int, _height int", *(f"{k} array<struct<_id:string, {BOX}>>" for k in kinds)])
    rows = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    out = None
    for kind in kinds:
        size = (F.coalesce(f"_{c}", F.lit(1)).alias(c) for c in ("width", "height"))
        part = rows.select(_book().alias("book"), F.col("_index").alias("page"), *size, F.lit(kind).alias("cls"), F.explode(kind).alias("t"))
        out = part if out is None else out.unionByName(part)
    sides = (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))
    return out.select("book", "page", "width", "height", "cls", F.col("t._id").alias("id"), *(F.coalesce(F.col(f"t._{s}").cast("double"), F.lit(0.0)).alias(a) for s, a in sides))


def read_nested_texts(spark: SparkSession, path: str, element: str = "text") -> DataFrame:
    """book, page, id and all text below each element, children included. The XML source drops children's text, so files are parsed whole."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for book, content in zip(part["book"], part["content"], strict=True):
                for page in tree.fromstring(content).iter("page"):
                    for node in page.iter(element):
                        rows.append((book, int(page.get("index", 0)), node.get("id"), "".join(node.itertext()).strip()))
            yield pd.DataFrame(rows, columns=["book", "page", "id", "text"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("book"), "content")
    return files.mapInPandas(run, "book string, page int, id string, text string")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_lines(spark: SparkSession, path: str, schema: str, key: str | None = None, order: str | None = None) -> DataFrame:
    """JSON lines, blank lines skipped; with ``key`` only the last row of a key (by ``order``) is kept."""
    rows = spark.read.schema(schema).json(path)
    if key is None:
        return rows
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


DETECTIONS = """images array<struct<image:string,width:int,height:int,
 detections:array<struct<class_id:int,class_name:string,score:double,box:array<double>,area:double,source:string>>>>"""


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """image, width, height, ord and the fields of every detection."""
    rows = read_document(spark, path, DETECTIONS).select(F.explode("images").alias("i"))
    flat = rows.select("i.image", "i.width", "i.height", F.posexplode("i.detections").alias("ord", "d"))
    return flat.select("image", "width", "height", "ord", "d.*")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a text list: a byte-order mark, blanks and comments are skipped."""
    value = F.btrim(F.regexp_replace("value", "^\ufeff", ""))
    return spark.read.text(path).select(value.alias("value")).filter(~F.col("value").rlike(r"^\s*(#|$)"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Single characters of a dictionary file, and the space; longer tokens have ``single`` false."""
    tokens = spark.read.text(path).select(F.translate("value", "\r\n", "").alias("token")).filter("token <> ''")
    space = spark.createDataFrame([(" ",)], "token string")
    return tokens.unionByName(space).distinct().withColumn("single", F.char_length("token") == 1)


def read_vectors(spark: SparkSession, path: str, arrays: tuple[str, ...]) -> DataFrame:
    """Rows of named arrays in NPZ files: key (file), name, ord and vec; half precision is widened."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, content in zip(part["key"], part["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as pack:
                    for name in arrays:
                        data = np.asarray(pack[name], dtype=np.float64)
                        rows += [(key, name, i, row.ravel().tolist()) for i, row in enumerate(data)]
            yield pd.DataFrame(rows, columns=["key", "name", "ord", "vec"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("key"), "content")
    return files.mapInPandas(run, "key string, name string, ord long, vec array<double>")


def image_size(head: bytes) -> tuple[int, int]:
    """Width and height from the header of a PNG, GIF, BMP or JPEG; (0, 0) if unknown."""
    if head[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", head[16:24])
    if head[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", head[6:10])
    if head[:2] == b"BM":
        w, h = struct.unpack("<ii", head[18:26])
        return w, abs(h)
    if head[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(head) and head[at] == 0xFF:
            marker, length = head[at + 1], struct.unpack(">H", head[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", head[at + 5 : at + 9])
                return w, h
            at += 2 + length
    return 0, 0


def list_images(spark: SparkSession, path: str, recursive: bool = True, suffixes: tuple[str, ...] = ("jpg", "jpeg", "png", "webp", "bmp", "gif")) -> DataFrame:
    """path, stem, width and height of files with one of the suffixes."""

    @F.pandas_udf(StructType([StructField("width", IntegerType()), StructField("height", IntegerType())]))
    def sizes(heads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([image_size(h) for h in heads], columns=["width", "height"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1).alias("stem"), sizes("content").alias("s")).select("path", "stem", "s.*")


def _json_files(spark: SparkSession, folder: str, schema: str, suffix: str = "") -> DataFrame:
    """key (the file's stem less ``suffix``) and d of the JSON files of a folder; a mark before the text is dropped."""
    if not folder_exists(spark, folder):
        return spark.createDataFrame([], f"key string, d struct<{schema}>")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}.json").load(folder)
    text = F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "")
    return files.select(F.regexp_extract("path", rf"([^/]*){suffix}\.json$", 1).alias("key"), F.from_json(text, schema).alias("d"))


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _four_numbers(box: Column) -> Column:
    """A box as four doubles, null if it has not four."""
    return F.when(F.size(box) == 4, F.transform(box, lambda v: v.cast("double")))


def ocr_lines(images: DataFrame, folder: str | None, key: str = "stem") -> DataFrame:
    """Each image's stem and its lines (box, text) from the file of that stem; without folder, file or lines an empty list.

    Lines whose box has not four numbers are left out.
    """
    spark = images.sparkSession
    schema = "ocr_lines array<struct<box:array<string>,text_for_review_only:string>>"
    found = _json_files(spark, folder, schema) if folder else spark.createDataFrame([], f"key string, d struct<{schema}>")
    kept = F.filter(F.transform("d.ocr_lines", lambda x: F.struct(_four_numbers(x["box"]).alias("box"), F.coalesce(x["text_for_review_only"], F.lit("")).alias("text"))), lambda x: x["box"].isNotNull())
    lines = found.select(F.col("key").alias(key), kept.alias("lines"))
    return images.select(key).distinct().join(lines, key, "left").select(key, F.coalesce("lines", F.array().cast("array<struct<box:array<double>,text:string>>")).alias("lines"))


def tail_boxes(images: DataFrame, folder: str | None, suffixes: tuple[str, ...] = ("_all", ""), key: str = "stem") -> DataFrame:
    """Each image's stem and its tail boxes, from the first of <stem><suffix>.json that exists; boxes of other than four numbers are left out."""
    spark = images.sparkSession
    schema = "tails array<struct<box:array<string>>>"
    stems = images.select(key).distinct()
    sources = [_json_files(spark, folder, schema, suffix).withColumnRenamed("key", key) for suffix in suffixes] if folder else []
    if not sources:
        return stems.withColumn("tails", F.array().cast("array<array<double>>"))
    kept = F.filter(F.transform("d.tails", lambda x: _four_numbers(x["box"])), lambda b: b.isNotNull())
    found = first_available([x.join(stems, key, "left_semi") for x in sources], key).select(key, kept.alias("tails"))
    return stems.join(found, key, "left").select(key, F.coalesce("tails", F.array().cast("array<array<double>>")).alias("tails"))


def first_available(sources: list[DataFrame], key: str) -> DataFrame:
    """All rows of the first source that has the key, in the order of the list."""
    ranked = None
    for i, source in enumerate(sources):
        part = source.withColumn("__s", F.lit(i))
        ranked = part if ranked is None else ranked.unionByName(part, allowMissingColumns=True)
    first = F.min("__s").over(Window.partitionBy(key))
    return ranked.withColumn("__f", first).filter("__s = __f").drop("__s", "__f")


def aligned_texts(index: DataFrame, texts: DataFrame, on: list[str], strict: bool = True) -> DataFrame:
    """Index rows with their text; a missing text is an error, or empty if not strict."""
    joined = index.join(texts, on, "left")
    if strict:
        return joined.withColumn("text", F.coalesce("text", F.raise_error(F.lit("a text of the index is missing"))))
    return joined.withColumn("text", F.coalesce("text", F.lit("")))
