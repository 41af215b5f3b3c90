"""Files of every format, written from the derived views and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkframe.functions import geometry as G
from inkframe.plans import fixtures as X
from inkframe.plans.registry import query
from inkframe.session import scratch, table
from inkframe.sources import packs as packs_, readers, versions, writers

R, I = X.REGION_SQL, X.INSTANCE_SQL
_SIDES = ("x1", "y1", "x2", "y2")


def _attribute(name: str, value: Column, keep: Column | None = None) -> Column:
    text = F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))
    return text if keep is None else F.when(keep, text).otherwise("")


#: Pages of one file.
BOOK = 500


def _xml(spark: SparkSession, rows: DataFrame, lines: Column, size: Column, name: str) -> str:
    """A folder of XML files, one per book of ``BOOK`` pages, with an element ``page`` per page, its lines in order."""
    ordered = lambda key, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value.alias("line")))), lambda x: x["line"]), "")
    pages = rows.groupBy("page_id", size.alias("size")).agg(ordered("ord", lines).alias("body"))
    page = F.concat(F.lit("<page"), _attribute("index", F.col("page_id")), F.col("size"), F.lit(">"), F.col("body"), F.lit("</page>"))
    books = pages.groupBy(F.expr(f"page_id div {BOOK}")).agg(ordered("page_id", page).alias("body"))
    path = scratch(spark, name)
    books.select(F.concat(F.lit("<book><pages>"), "body", F.lit("</pages></book>")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def _named(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "part").select(F.col("p_partkey").alias("part_key"), "p_name")
    return X.regions(spark, folder).join(names, "part_key")


def _box(keep: Column | None = None) -> Column:
    return F.concat(*(_attribute(a, F.col(c), keep if a == "xmin" else None) for a, c in zip(("xmin", "ymin", "xmax", "ymax"), _SIDES, strict=True)))


FULL = ' width="1600" height="2200"'


@query(
    f"""WITH {R} SELECT page_id AS page, CAST(region_id AS VARCHAR) AS id, p_name AS text, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2, 1600 AS width, 2200 AS height, CAST(x2 AS DOUBLE) AS corner_x, CAST(y2 AS DOUBLE) AS corner_y
FROM region JOIN part ON p_partkey = part_key WHERE cls = 'text'"""
)
def xml_rectangles(spark: SparkSession, folder: str) -> DataFrame:
    """Rectangles with stripped text and a polygon of four corners."""
    rows = _named(spark, folder).filter("cls = 'text'")
    line = F.concat(F.lit("<text"), _attribute("id", F.col("region_id")), _box(), F.lit("> "), F.col("p_name"), F.lit(" </text>"))
    found = readers.read_rectangles(spark, _xml(spark, rows, line, F.lit(FULL), "rectangles"))
    third = F.get("polygon", F.lit(2))
    return found.select("page", "id", "text", *_SIDES, "width", "height", third["x"].alias("corner_x"), third["y"].alias("corner_y"))


@query(
    f"""WITH {R} SELECT page_id AS page, CAST(region_id AS VARCHAR) AS id, CASE WHEN part_key % 5 = 1 THEN 3 ELSE 4 END AS corners, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM region WHERE cls = 'body' AND part_key % 5 > 0"""
)
def xml_polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Polygons up to the first missing corner, those of two corners dropped."""
    k = F.col("part_key") % 5
    corners = [("x1", "y1", None), ("x2", "y1", None), ("x2", "y2", k > 0), ("x1", "y2", k != 1)]
    points = [_attribute(f"{a}{i}", F.col(c), keep) for i, (x, y, keep) in enumerate(corners) for a, c in (("x", x), ("y", y))]
    line = F.concat(F.lit("<onomatopoeia"), _attribute("id", F.col("region_id")), *points, F.lit("/>"))
    rows = X.regions(spark, folder).filter("cls = 'body'")
    found = readers.read_polygons(spark, _xml(spark, rows, line, F.lit(FULL), "polygons"))
    return found.select("page", "id", F.size("polygon").alias("corners"), *_SIDES)


@query(
    f"""WITH {R} SELECT page_id AS page, cls, CAST(region_id AS VARCHAR) AS id, CAST(supp_key % 7 AS VARCHAR) AS character_id, x1, y1, x2, y2 FROM region WHERE cls <> 'text'"""
)
def xml_objects(spark: SparkSession, folder: str) -> DataFrame:
    """A3: faces, bodies and frames with whole-number boxes; a coordinate may be written with a fraction."""
    box = F.concat(*(_attribute(a, F.concat(F.col(c).cast("string"), F.lit(".0")) if a == "xmax" else F.col(c)) for a, c in zip(("xmin", "ymin", "xmax", "ymax"), _SIDES, strict=True)))
    line = F.concat(F.lit("<"), F.col("cls"), _attribute("id", F.col("region_id")), _attribute("character", F.col("supp_key") % 7), box, F.lit("/>"))
    rows = X.regions(spark, folder).filter("cls <> 'text'")
    return readers.read_objects(spark, _xml(spark, rows, line, F.lit(FULL), "objects")).select("page", "cls", "id", "character_id", *_SIDES)


@query(
    f"""WITH {R} SELECT page_id AS page, CASE WHEN page_id % 2 = 0 THEN 1600 ELSE 1 END AS width, CASE WHEN page_id % 2 = 0 THEN 2200 ELSE 1 END AS height, cls, CAST(region_id AS VARCHAR) AS id,
  CASE WHEN part_key % 3 = 0 THEN 0.0 ELSE CAST(x1 AS DOUBLE) END AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x2 AS DOUBLE) AS x2, CAST(y2 AS DOUBLE) AS y2 FROM region WHERE cls IN ('text', 'body')"""
)
def xml_boxes(spark: SparkSession, folder: str) -> DataFrame:
    """A4: boxes by id; missing coordinates are 0 and missing page sizes 1."""
    line = F.concat(F.lit("<"), F.col("cls"), _attribute("id", F.col("region_id")), _box(F.col("part_key") % 3 != 0), F.lit("/>"))
    rows = X.regions(spark, folder).filter("cls IN ('text', 'body')")
    size = F.when(F.col("page_id") % 2 == 0, FULL).otherwise("")
    return readers.read_boxes(spark, _xml(spark, rows, line, size, "boxes")).select("page", "width", "height", "cls", "id", *_SIDES)


@query(f"""WITH {R} SELECT page_id AS page, CAST(region_id AS VARCHAR) AS id, '  ' || p_name || ' ' AS text FROM region JOIN part ON p_partkey = part_key WHERE cls = 'text'""")
def xml_transcripts(spark: SparkSession, folder: str) -> DataFrame:
    """A5: texts with their white space; an id twice on a page would be an error."""
    rows = _named(spark, folder).filter("cls = 'text'")
    line = F.concat(F.lit("<text"), _attribute("id", F.col("region_id")), F.lit(">  "), F.col("p_name"), F.lit(" </text>"))
    return readers.read_transcripts(spark, _xml(spark, rows, line, F.lit(FULL), "transcripts"), strict=True).select("page", "id", "text")


@query("""SELECT c_nationkey AS nation, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS place, c_custkey AS customer, c_name AS name FROM customer""")
def json_document(spark: SparkSession, folder: str) -> DataFrame:
    """Nested, pretty documents of a thousand customers each, read whole and indexed again."""
    rows = table(spark, folder, "customer").select(F.col("c_nationkey").cast("long").alias("nation"), F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"), F.expr("c_custkey div 1000").alias("part"))
    groups = writers.nested(rows, ["part", "nation"], "customer", ["customer", "name"], "members")
    documents = groups.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("nation", "members"))).alias("groups"))
    path = scratch(spark, "document")
    text = F.to_json(F.struct("groups"), {"ignoreNullFields": "false", "pretty": "true"})
    packs_.write_files(documents.select(F.format_string("part%09d.json", "part").alias("name"), text.alias("content")), path)
    found = readers.read_document(spark, path, "groups array<struct<nation:long,members:array<struct<customer:long,name:string>>>>")
    flat = found.select(F.explode("groups").alias("g")).select("g.nation", F.explode("g.members").alias("m")).select("nation", "m.*")
    place = F.row_number().over(Window.partitionBy("nation").orderBy("customer")) - 1
    return flat.select("nation", place.alias("place"), "customer", "name")


@query("""SELECT event_id, event_type, value, CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END AS user_id FROM events""")
def json_lines(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines with blank lines between them."""
    rows = table(spark, folder, "events").select("event_id", "event_type", "value", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("user_id"))
    lines = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    path = scratch(spark, "lines")
    rows.select(F.explode(F.array(lines, F.lit(""))).alias("value")).write.text(path)
    return readers.read_lines(spark, path, "event_id long, event_type string, value double, user_id long")


@query("""SELECT p_name AS value, count(*) AS n FROM part WHERE p_partkey % 3 > 0 GROUP BY p_name""")
def text_list(spark: SparkSession, folder: str) -> DataFrame:
    """A list with marks, blanks and comments."""
    k = F.col("p_partkey") % 3
    lines = table(spark, folder, "part").select(F.when(k == 0, F.concat(F.lit(" # "), "p_name")).when(k == 1, F.concat(F.lit("\ufeff "), "p_name")).otherwise(F.concat("p_name", F.lit("  "))).alias("value"))
    path = scratch(spark, "list")
    lines.select(F.explode(F.array("value", F.lit("  "))).alias("value")).write.text(path)
    return readers.read_list(spark, path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS conv_id, array_to_string(list(role ORDER BY turn), '|') AS roles FROM conversations GROUP BY conv_id""")
def csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    """CSV with a byte-order mark, columns in a fixed order, lists joined."""
    rows = writers.nested(table(spark, folder, "conversations"), ["conv_id"], "turn", ["role"], "roles")
    path = scratch(spark, "csv")
    writers.write_csv(rows.select(F.transform("roles", lambda r: r["role"]).alias("roles"), "conv_id"), path, ["conv_id", "roles"])
    found = spark.read.option("header", True).csv(path)
    return found.toDF(*(c.lstrip(writers.BOM) for c in found.columns)).select("conv_id", "roles")


@query(f"""WITH {I} SELECT vec_id, 'v2' AS signature, round(vec[1] + vec[64], 6) AS ends FROM inst""")
def stored_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors beside the signature of what they were made from, which the reader asks for."""
    rows = X.instances(spark, folder).select("vec_id", "vec")
    path = scratch(spark, "vectors")
    writers.write_vectors(rows, path, "v2")
    found = spark.read.parquet(path).filter("signature = 'v2'")
    return found.select("vec_id", "signature", (F.get("vec", F.lit(0)) + F.get("vec", F.lit(63))).alias("ends"))


@query(f"""WITH {I} SELECT vec_id, input_type, round(vec[1] + vec[64], 6) AS ends FROM inst""")
def array_packs(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors, ids and texts written as packs of arrays and read back row by row, aligned by their place."""
    rows = X.instances(spark, folder).select("vec_id", "input_type", "vec", F.format_string("pack%09d", F.expr("vec_id div 100")).alias("pack"))
    one = F.array_sort(F.collect_list(F.struct("vec_id", "input_type", "vec")))  # at most 100 rows
    packs = rows.groupBy("pack").agg(one.alias("r")).withColumn("n", F.size("r").cast("long"))
    none, text = F.lit(None).cast("array<double>"), F.lit(None).cast("array<string>")
    array = lambda name, kind, shape, values, texts: F.struct(F.lit(name).alias("array"), F.lit(kind).alias("kind"), shape.alias("shape"), values.alias("values"), texts.alias("texts"))
    numbers = lambda field: F.transform("r", lambda x: x[field].cast("double"))
    arrays = F.array(
        array("ids", "int64", F.array("n"), numbers("vec_id"), text),
        array("vectors", "float64", F.array("n", F.lit(64).cast("long")), F.flatten(F.transform("r", lambda x: x["vec"])), text),
        array("types", "text", F.array("n"), none, F.transform("r", lambda x: x["input_type"])),
    )
    path = scratch(spark, "packs")
    packs_.write_packs(packs.select("pack", F.explode(arrays).alias("a")).select("pack", "a.*"), path)
    found = packs_.read_packs(spark, path).filter(F.col("array").isin("ids", "vectors", "types"))
    of = lambda name, column: F.max(F.when(F.col("array") == name, F.col(column)))
    back = found.groupBy("pack").agg(of("ids", "values").alias("ids"), of("vectors", "values").alias("flat"), of("types", "texts").alias("types"))
    each = back.select("flat", "types", F.posexplode("ids").alias("at", "id"))
    ends = F.get("flat", F.col("at") * 64) + F.get("flat", F.col("at") * 64 + 63)
    return each.select(F.col("id").cast("long").alias("vec_id"), F.get("types", F.col("at")).alias("input_type"), ends.alias("ends"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(attempt) AS BIGINT) AS attempts FROM events, (SELECT unnest([1, 2]) AS attempt) GROUP BY event_type""")
def audit_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Audit rows appended twice, without credentials."""
    rows = table(spark, folder, "events").select("event_id", "event_type", F.lit("secret").alias("api_key"))
    path = scratch(spark, "audit")
    for attempt in (1, 2):
        writers.append_audit(rows.withColumn("attempt", F.lit(attempt)), path)
    found = spark.read.json(path)
    if "api_key" in found.columns:
        raise RuntimeError("credentials were written")
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("attempt").alias("attempts"))


@query(
    """WITH e AS (SELECT event_type, event_id, value, (event_id % 4 + 1)::BIGINT AS epoch FROM events), m AS (SELECT epoch, event_type, avg(value) AS metric FROM e GROUP BY ALL),
b AS (SELECT v AS version, event_type, max(metric) AS best, arg_max(epoch, [metric, -epoch]) AS best_epoch FROM m, range(1, 5) t(v) WHERE epoch <= v GROUP BY ALL)
SELECT version, 'epoch ' || version AS note, event_type, best_epoch, round(best, 6) AS best, (SELECT count(DISTINCT event_type) FROM m WHERE epoch <= version) AS rows FROM b"""
)
def version_history(spark: SparkSession, folder: str) -> DataFrame:
    """The best epoch so far as a table that each epoch replaces; all versions with their history."""
    metrics = table(spark, folder, "events").groupBy((F.col("event_id") % 4 + 1).alias("epoch"), "event_type").agg(F.avg("value").alias("metric"))
    store = versions.Versions(spark, scratch(spark, "versions"))
    for epoch in range(1, 5):
        fresh = metrics.filter(F.col("epoch") == epoch)

        def better(old: DataFrame | None, fresh: DataFrame = fresh) -> DataFrame:
            rows = fresh if old is None else old.unionByName(fresh)
            best = F.max(F.struct("metric", (-F.col("epoch")).alias("before")))
            return rows.groupBy("event_type").agg(best.alias("b")).select("event_type", (-F.col("b.before")).alias("epoch"), F.col("b.metric").alias("metric"))

        store.publish(better, f"epoch {epoch}")
    found = [store.read(v).select(F.lit(v).cast("long").alias("version"), "event_type", F.col("epoch").alias("best_epoch"), F.col("metric").alias("best")) for v in store.versions()]
    rows = found[0]
    for other in found[1:]:
        rows = rows.unionAll(other)
    return rows.join(store.history(), "version").select("version", "note", "event_type", "best_epoch", "best", "rows")


@query("""SELECT d.doc_id, coalesce(b.text, '') AS text FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""")
def aligned_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Texts in the order of an index; a missing one is empty."""
    index = table(spark, folder, "documents").select("doc_id")
    texts = table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return readers.aligned_texts(index, texts, ["doc_id"], strict=False)


@query(
    f"""WITH {R}, s AS (SELECT region_id, w, h, 896.0 / greatest(w, h) AS f FROM region), d AS (SELECT region_id, greatest(1, CAST(round_even(w * f, 0) AS BIGINT)) AS width, greatest(1, CAST(round_even(h * f, 0) AS BIGINT)) AS height FROM s)
SELECT region_id, width, height, CAST(ceil(width / 16) * 16 AS BIGINT) AS padded_width, CAST(ceil(height / 16) * 16 AS BIGINT) AS padded_height FROM d"""
)
def padded_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes scaled to a long side and padded to whole patches."""
    rows = X.regions(spark, folder)
    return rows.select("region_id", G.fit_dimensions(F.col("w"), F.col("h"), 896, 16).alias("d")).select("region_id", "d.*")


# ---- files beside images -------------------------------------------------------------------

_STEM = "'img' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0')"


def _images(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as images: stem, key and the size that their headers give."""
    key = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(F.format_string("img%06d", key).alias("stem"), key.alias("key"), (key * 7 % 900 + 1).alias("width"), (key * 11 % 1300 + 1).alias("height"), "s_name")


def _written_images(spark: SparkSession, rows: DataFrame) -> str:
    """Headers of PNG and GIF files, and files of other kinds, in one folder."""
    big = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    little = lambda c: F.unhex(F.concat(F.lpad(F.hex(c % 256), 2, "0"), F.lpad(F.hex(F.floor(c / 256)), 2, "0")))
    png = F.concat(F.unhex(F.lit("89504E470D0A1A0A0000000D49484452")), big(F.col("width")), big(F.col("height")))
    gif = F.concat(F.lit("GIF89a").cast("binary"), little(F.col("width")), little(F.col("height")))
    kind = F.col("key") % 4
    suffix = F.when(kind == 0, ".gif").when(kind == 1, ".PNG").when(kind == 2, ".png").otherwise(".txt")
    path = scratch(spark, "images")
    packs_.write_files(rows.select(F.concat("stem", suffix).alias("name"), F.when(kind == 0, gif).otherwise(png).alias("content")), path)
    return path


@query(f"SELECT {_STEM} AS stem, s_suppkey * 7 % 900 + 1 AS width, s_suppkey * 11 % 1300 + 1 AS height FROM supplier WHERE s_suppkey % 4 <> 3")
def listed_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of a folder with the sizes in their headers; files of other kinds are no images."""
    path = _written_images(spark, _images(spark, folder))
    found = readers.list_images(spark, path, suffixes=("png", "PNG", "gif"))
    return found.select("stem", "width", "height")


@query(
    f"""SELECT {_STEM} AS stem, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 5 ELSE 0 END AS lines, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 > 0 THEN s_name || ' 0' ELSE '' END AS text,
  CASE WHEN s_suppkey % 4 = 0 THEN 2 WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS tails, CASE WHEN s_suppkey % 4 = 0 THEN 1.5 WHEN s_suppkey % 5 = 0 THEN CAST(s_suppkey AS DOUBLE) END AS x FROM supplier"""
)
def side_files(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and tails of each image from files of its stem; the first name that exists is taken, boxes without four numbers are not."""
    rows = _images(spark, folder)
    box = lambda *v: F.array(*(x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in v))
    key = F.col("key")
    number = F.sequence(F.lit(0).cast("long"), key % 5)
    lines = F.transform(number, lambda i: F.struct(F.when(i == key % 5, box(1, 2)).otherwise(box(i, 0, 9, 9)).alias("box"), F.concat(F.col("s_name"), F.lit(" "), i.cast("string")).alias("text_for_review_only")))
    tails = lambda *boxes: F.to_json(F.struct(F.array(*(F.struct(b.alias("box")) for b in boxes)).alias("tails")))
    bundles, ends = scratch(spark, "bundles"), scratch(spark, "tails")
    packs_.write_files(rows.filter("key % 3 = 0").select(F.concat("stem", F.lit(".json")).alias("name"), F.to_json(F.struct(lines.alias("ocr_lines"))).alias("content")), bundles)
    full = rows.filter("key % 4 = 0").select(F.concat("stem", F.lit("_all.json")).alias("name"), tails(box(1.5, 0, 1, 1), box(2, 0, 1, 1), box(3)).alias("content"))
    other = rows.filter("key % 5 = 0").select(F.concat("stem", F.lit(".json")).alias("name"), tails(box(key, 0, 1, 1)).alias("content"))
    packs_.write_files(full.unionAll(other), ends)
    found = readers.ocr_lines(rows, bundles).join(readers.tail_boxes(rows, ends), "stem")
    first = lambda c: F.get(c, F.lit(0))
    return found.select("stem", F.size("lines").alias("lines"), F.coalesce(first("lines")["text"], F.lit("")).alias("text"), F.size("tails").alias("tails"), F.get(first("tails"), F.lit(0)).alias("x"))


@query("SELECT 'book' || n_nationkey AS book, r_name AS text, CAST(n_nationkey + 5 AS DOUBLE) AS x2 FROM nation JOIN region ON r_regionkey = n_regionkey")
def book_files(spark: SparkSession, folder: str) -> DataFrame:
    """One file of marks per book, whose name is the book; files of other names are passed over."""
    nations = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    page = F.format_string('<book><pages><page index="1"><text id="t" xmin="1" ymin="2" xmax="%d" ymax="4">%s</text></page></pages></book>', F.col("n_nationkey") + 5, F.col("r_name"))
    path = scratch(spark, "books")
    files = nations.select(F.concat(F.lit("book"), F.col("n_nationkey").cast("string")).alias("book"), page.alias("content"))
    packs_.write_files(files.select(F.concat("book", F.lit(".xml")).alias("name"), "content").unionAll(files.select(F.concat("book", F.lit(".txt")).alias("name"), "content")), path)
    return readers.read_rectangles(spark, f"{path}/*.xml").select("book", "text", "x2")


@query(
    """WITH r AS (SELECT event_type AS run, CAST(round(avg(value), 3) AS VARCHAR) AS metric FROM events GROUP BY event_type), e AS (SELECT unnest(['click', 'absent', 'view', 'purchase', 'gone']) AS run, unnest(range(5)) AS i)
SELECT '# Runs' || chr(10) || chr(10) || '| run | metric |' || chr(10) || '| --- | --- |' || chr(10) || (SELECT string_agg('| ' || e.run || ' | ' || coalesce(metric, '?') || ' |', chr(10) ORDER BY i) FROM e LEFT JOIN r ON r.run = e.run)
  || coalesce(chr(10) || chr(10) || 'Missing files:' || chr(10) || chr(10) || (SELECT string_agg('- `' || run || '`', chr(10) ORDER BY i) FROM e WHERE run NOT IN (SELECT run FROM r)), '') || chr(10) AS text"""
)
def run_comparison(spark: SparkSession, folder: str) -> DataFrame:
    """A comparison of expected runs as text, with question marks and a list of what is missing, written and read back."""
    runs = table(spark, folder, "events").groupBy(F.col("event_type").alias("run")).agg(F.round(F.avg("value"), 3).cast("string").alias("metric"))
    text = writers.comparison("Runs", runs, ["click", "absent", "view", "purchase", "gone"], "run", ["metric"])
    path = scratch(spark, "comparison")
    packs_.write_files(spark.createDataFrame([("comparison.md", text)], "name string, content string"), path)
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"))
