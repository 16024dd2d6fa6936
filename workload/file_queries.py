"""Files in and out: the given tables are written to the shared folder in the formats
of the sources, read back by them, and changed by the sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpuskit.operators import evaluation, merge, quality, review
from corpuskit.operators.filters import applicable, undescribed
from corpuskit.operators.layout import figure_regions, image_report, paragraph_captions
from corpuskit.operators.ranking import union_all
from corpuskit.operators.scorers import guarded, hashed_embedding, split_results
from corpuskit.plans import load
from corpuskit.plans.backfill import reembed
from corpuskit.schemas import DESCRIPTION
from corpuskit.session import shared_folder
from corpuskit.sinks import tables
from corpuskit.sources import files
from workload.registry import query
from workload.table_queries import RECORDS_SQL, records
from workload.tables import table

PER_FILE = 500  # records in one array file: a file is one unit of work


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _array_files(rows, key, folder):
    """JSON array files of at most PER_FILE consecutive records, a folder each."""
    number = F.floor(F.col(key) / PER_FILE)
    record = F.to_json(F.struct(*[c for c in rows.columns if c != key]))
    arrays = rows.groupBy(number.alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    arrays.write.partitionBy("file").text(folder)


def _chunk_files(spark, sf):
    """Both releases of the records as files; [all documents, good ones again]."""
    rows = records(spark, sf).drop("row_ord").withColumn("_key", F.col("id").cast("long"))
    folders = []
    for release in (0, 1):
        folders.append(_folder(spark, "release"))
        _array_files(rows.where(F.col("file_ord") == release).drop("file_ord"), "_key", folders[-1])
    return folders


@query(f"WITH {RECORDS_SQL} SELECT id, heading, md5(coalesce(text, '')) AS text_md5, CAST(file_ord AS INTEGER) AS file_ord FROM records")
def chunk_files(spark, sf):
    read = files.read_chunks(spark, _chunk_files(spark, sf))
    return read.select("id", "heading", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), "file_ord")


LOADED_SQL = f"WITH {RECORDS_SQL} SELECT id, node_type, heading, md5(text) AS text_md5, jurisdictions FROM unique_rows"


def _loaded(df):
    return df.select("id", "node_type", "heading", F.md5("text").alias("text_md5"), F.array_join("jurisdictions", "|").alias("jurisdictions"))


@query(LOADED_SQL)
def load_from_files(spark, sf):
    """The good documents are loaded first, then both releases over them."""
    folders, root = _chunk_files(spark, sf), _folder(spark, "corpus")
    load.load_corpus(spark, files.read_chunks(spark, folders[1:]), root, "v0")
    load.load_corpus(spark, files.read_chunks(spark, folders), root, "v1")
    tables.remove_old_versions(spark, root)
    return _loaded(tables.read_table(spark, root))


@query(f"WITH {RECORDS_SQL} SELECT id, heading, dataset_version FROM (SELECT id, heading, 'v1' AS dataset_version FROM table_rows WHERE file_ord = 1)")
def load_replaces_the_table(spark, sf):
    """A truncating load leaves only what it brought; a dry run changes nothing."""
    folders, root = _chunk_files(spark, sf), _folder(spark, "corpus")
    load.load_corpus(spark, files.read_chunks(spark, folders[:1]), root, "v0")
    load.load_corpus(spark, files.read_chunks(spark, folders[1:]), root, "v1", truncate=True)
    load.load_corpus(spark, files.read_chunks(spark, folders), root, "v2", dry_run=True)
    return tables.read_table(spark, root).select("id", "heading", "dataset_version")


DESCRIBED_SQL = """
lines AS (SELECT 'img/figure-' || (p_partkey // 2) || '.PNG' AS image, p_name || CASE WHEN p_size > 45 THEN '' ELSE '!' END AS description, p_partkey AS n FROM part WHERE p_size % 7 <> 0),
flat AS (SELECT 'figure-' || s_suppkey || '.svg' AS image, s_name AS description, s_suppkey AS n FROM supplier WHERE s_suppkey % 3 <> 0),
additions AS (SELECT 0 AS store, image, description, n FROM lines UNION ALL SELECT 1, image, description, n FROM flat),
named AS (SELECT regexp_extract(image, '[^/]*$') AS name, regexp_replace(regexp_extract(image, '[^/]*$'), '[.][^.]*$', '') AS stem, * FROM additions),
exact AS (SELECT name, max_by(description, (store, n)) AS text FROM named GROUP BY name),
stems AS (SELECT stem, min_by(description, (store, n)) AS text FROM named GROUP BY stem)"""


@query(
    f"""WITH {DESCRIBED_SQL}, figures AS (SELECT p_partkey AS id, 'figure-' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.PNG' ELSE '.svg' END AS name FROM part)
    SELECT f.id, coalesce(e.text, s.text) AS description FROM figures f LEFT JOIN exact e ON e.name = f.name LEFT JOIN stems s ON s.stem = regexp_replace(f.name, '[.][^.]*$', '')"""
)
def description_files(spark, sf):
    """A JSONL store in two folders and flat indexes, looked up by name, then by stem."""
    p, s = table(spark, sf, "part"), table(spark, sf, "supplier")
    text = F.concat("p_name", F.when(F.col("p_size") > 45, F.lit("")).otherwise(F.lit("!")))
    image = F.concat(F.lit("img/figure-"), F.floor(F.col("p_partkey") / 2), F.lit(".PNG"))
    store = p.where("p_size % 7 <> 0").select(
        F.to_json(F.struct(image.alias("image"), text.alias("description"), F.col("p_partkey").alias("chars"))).alias("value"), "p_partkey"
    )
    noise = spark.range(3).select(F.element_at(F.array(F.lit(""), F.lit("{broken"), F.lit('{"image": "x.png"}')), (F.col("id") + 1).cast("int")).alias("value"))
    paths = []
    # The store goes on in a second folder; a file holds at most PER_FILE keys, in order.
    pair = F.struct("p_partkey", "value")
    for part in (F.col("p_partkey") <= 700, F.col("p_partkey") > 700):
        paths.append(_folder(spark, "store"))
        grouped = store.where(part).groupBy(F.floor(F.col("p_partkey") / PER_FILE).alias("file")).agg(F.array_sort(F.collect_list(pair)).alias("pairs"))
        grouped.select("file", F.array_join("pairs.value", "\n").alias("value")).write.partitionBy("file").text(paths[-1])
    noise.write.mode("append").text(paths[0])
    lines = files.read_jsonl(spark, paths, DESCRIPTION, ["image", "description"]).select("image", "description", F.struct(F.col("line.file").alias("file"), F.col("chars").alias("at"), F.col("line.n").alias("n")).alias("line"))
    flat = _folder(spark, "index")
    entry = F.struct(F.concat(F.lit("figure-"), "s_suppkey", F.lit(".svg")).alias("k"), F.col("s_name").alias("v"))
    objects = s.where("s_suppkey % 3 <> 0").groupBy(F.floor(F.col("s_suppkey") / PER_FILE).alias("file")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    objects.write.partitionBy("file").text(flat)
    index = files.read_flat_index(spark, [flat])
    additions = files.description_additions(lines, index)
    kind = F.when(F.col("p_partkey") % 2 == 0, F.lit(".PNG")).otherwise(F.lit(".svg"))
    figures = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("figure-"), "p_partkey", kind).alias("name"))
    return files.describe(figures, "name", additions).select("id", "description")


@query("SELECT DISTINCT 'o_orderstatus=' || o_orderstatus AS folder, o_orderpriority || '.Parquet' AS kind FROM orders")
def image_files(spark, sf):
    """A folder tree is listed; labels are paths below its root."""
    root = _folder(spark, "tree")
    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey")
    o.write.partitionBy("o_orderstatus", "o_orderpriority").parquet(root)
    found = files.find_files(spark, [root], [".PARQUET"])
    label = F.split("label", "/")
    priority = F.try_url_decode(F.substring_index(F.get(label, 1), "=", -1))
    return found.select(F.get(label, 0).alias("folder"), F.concat(priority, F.lit(".Parquet")).alias("kind")).distinct()


@query("SELECT source AS doc, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY source")
def chunk_folders(spark, sf):
    """Chunk files, a folder per document; working columns are left out."""
    path = _folder(spark, "chunks")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("doc"), F.lit(1).alias("pre"), F.lit("c").alias("corpus"))
    tables.write_chunks(d, path)
    back = spark.read.parquet(path)
    if {"pre", "corpus"} & set(back.columns):
        raise ValueError("working columns were written")
    return back.groupBy("doc").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).cast("long").alias("chars"))


@query(
    """SELECT 'lang' AS section, lang AS name, count(*) AS n FROM documents GROUP BY lang
    UNION ALL SELECT 'quality', CAST(quality AS VARCHAR), count(*) FROM labels GROUP BY quality"""
)
def report_file(spark, sf):
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    counts = {
        "lang": d.groupBy(F.col("lang").alias("name")).agg(F.count(F.lit(1)).alias("n")),
        "quality": labels.groupBy(F.col("quality").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")),
    }
    path = _folder(spark, "report")
    tables.write_report(quality.report(counts), path)
    body = F.from_json("body", "name string, n long")
    return spark.read.schema("section string, body string").json(path).select("section", body["name"].alias("name"), body["n"].alias("n"))


@query("SELECT 'figure-' || p_partkey || '.png' AS image, p_name AS description FROM part")
def index_file(spark, sf):
    path = _folder(spark, "flat")
    p = table(spark, sf, "part").select(F.concat(F.lit("figure-"), "p_partkey", F.lit(".png")).alias("image"), F.col("p_name").alias("description"), "p_size")
    tables.write_index(p, path)
    return spark.read.schema("image string, description string").json(path)


@query("SELECT event_type AS clause_id, CAST(user_id AS VARCHAR) AS query, count(*) AS n, count(DISTINCT event_id) AS ids FROM events GROUP BY ALL")
def feedback_log(spark, sf):
    """Feedback appended in two writes; every row gets an id of its own."""
    path = _folder(spark, "feedback")
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("clause_id"), F.col("user_id").cast("string").alias("query"), F.lit("missing").alias("reported_status"))
    for half in (0, 1):
        tables.append(tables.feedback_rows(e.where(F.col("event_id") % 2 == half)), path)
    back = spark.read.parquet(path).where("created_at IS NOT NULL AND doc IS NULL")
    return back.groupBy("clause_id", "query").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


# -- layouts ---------------------------------------------------------------------------

SIZES_SQL = """
images AS (SELECT l_orderkey AS doc_id, l_linenumber * 10000000 + l_partkey AS image_id, CAST(l_quantity * 10 AS INTEGER) AS width, 400 AS height, CAST(l_extendedprice AS BIGINT) AS bytes, l_returnflag AS flag FROM lineitem),
kinds AS (SELECT *, (width < 200) OR bytes < 8192 AS decorative FROM images),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY image_id, width, bytes, flag) AS r FROM kinds WHERE NOT decorative) WHERE r <= 3)"""


@query(
    f"""WITH {SIZES_SQL}, outcome AS (SELECT doc_id, count(*) AS kept, count(*) FILTER (flag = 'R') AS described, count(*) FILTER (flag <> 'R') AS failed,
      count(*) FILTER (flag <> 'N') AS captioned FROM kept GROUP BY doc_id)
    SELECT k.doc_id, k.found AS images_found, k.skipped AS images_skipped, coalesce(described, 0) AS described, coalesce(failed, 0) AS failed, coalesce(captioned, 0) AS captioned,
      found - skipped > coalesce(kept, 0) AS truncated
    FROM (SELECT doc_id, count(*) AS found, count(*) FILTER (decorative) AS skipped FROM kinds GROUP BY doc_id) k LEFT JOIN outcome o ON o.doc_id = k.doc_id"""
)
def image_reports(spark, sf):
    li = table(spark, sf, "lineitem")
    images = li.select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("image_id"), (F.col("l_quantity") * 10).cast("int").alias("width"),
        F.lit(400).alias("height"), F.round("l_extendedprice").cast("long").alias("bytes"), "l_returnflag",
    ).withColumn("image_ord", F.struct("image_id", "width", "bytes", "l_returnflag"))
    # Lines that share a number and a part are one image each: keyed with their order.
    keyed = images.withColumn("image_id", F.to_json("image_ord"))
    captions = keyed.where("l_returnflag <> 'N'").select("doc_id", "image_id", F.lit("c").alias("text")).distinct()
    results = keyed.select("doc_id", "image_id", (F.col("l_returnflag") == "R").alias("ok")).distinct()
    return image_report(keyed, captions, results, cap=3)


@query(
    """WITH p AS (SELECT conv_id AS doc_id, turn AS para_ord, CASE turn % 4 WHEN 0 THEN 'Figure ' || turn || ': view' WHEN 1 THEN 'Plain words' WHEN 2 THEN 'A styled line' ELSE '' END AS text,
      turn % 4 = 2 AS styled FROM conversations),
    d AS (SELECT conv_id AS doc_id, turn AS para_ord, CASE WHEN turn % 5 = 1 THEN 'Drawing of ' || conv_id WHEN turn % 5 = 2 THEN 'Picture 7' END AS alt FROM conversations),
    c AS (SELECT doc_id, para_ord, alt AS text, 'alt-text' AS source, 0.95 AS confidence, 0 AS try FROM d WHERE alt IS NOT NULL AND alt <> 'Picture 7'
      UNION ALL SELECT d.doc_id, d.para_ord, p.text, CASE WHEN styled THEN 'caption-style' ELSE 'caption-pattern' END,
        (CASE WHEN styled THEN 0.9 ELSE 0.75 END) - CASE WHEN o.try = 3 THEN 0.05 ELSE 0 END, o.try
      FROM d JOIN (VALUES (1, 0), (2, 1), (3, -1)) o(try, shift) ON true JOIN p ON p.doc_id = d.doc_id AND p.para_ord = d.para_ord + o.shift WHERE styled OR p.text LIKE 'Figure%')
    SELECT doc_id, para_ord, text, source, round(confidence, 2)::DOUBLE AS confidence FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, para_ord ORDER BY confidence DESC, try) = 1"""
)
def drawing_captions(spark, sf):
    """Turns of a conversation as paragraphs, each with a drawing."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("para_ord"))
    kind, five = F.col("para_ord") % 4, F.col("para_ord") % 5
    text = F.when(kind == 0, F.concat(F.lit("Figure "), "para_ord", F.lit(": view"))).when(kind == 1, "Plain words").when(kind == 2, "A styled line").otherwise("")
    paragraphs = c.select("*", text.alias("text"), F.when(kind == 2, "Figure Caption").otherwise("Normal").alias("style"))
    alt = F.when(five == 1, F.concat(F.lit("Drawing of "), "doc_id")).when(five == 2, "Picture 7")
    drawings = c.select("*", F.lit("r1").alias("rel_id"), alt.alias("alt"), F.lit(None).cast("string").alias("shape_name"))
    return paragraph_captions(drawings, paragraphs).select("doc_id", "para_ord", "text", "source", F.round("confidence", 2).alias("confidence"))


REGION_SQL = """
caps AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, l_linenumber % 3 + l_partkey % 40 AS number, l_partkey, 100.0 + l_quantity AS y0, 112.0 + l_quantity AS y1 FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_quantity) = 1),
art AS (SELECT c.doc_id, c.page, c.number, c.y0, c.y1, min(y1 + 10 + s) AS ay0, max(y1 + 10 + s + h) AS ay1, min(80.0 + s) AS ax0, max(80.0 + s + 150) AS ax1
  FROM caps c JOIN (VALUES (0, 60.0), (30, 200.0), (700, 20.0)) d(s, h) ON true WHERE l_partkey % 3 <> 0 AND y1 + 10 + s + h <= 810 GROUP BY ALL),
region AS (SELECT doc_id, page, number, y0, greatest(least(ax0, 60.0) - 8, 0) AS rx0, greatest(least(ay0, y0) - 8, 0) AS ry0, least(greatest(ax1, 200.0) + 8, 500.0) AS rx1, least(greatest(ay1, y1) + 8, 842.0) AS ry1 FROM art)"""


@query(
    f"""WITH {REGION_SQL} SELECT doc_id, CAST(number AS VARCHAR) AS number, page, 'figure-' || number || '.png' AS file_name, rx0::DOUBLE AS x0, ry0::DOUBLE AS y0, rx1::DOUBLE AS x1, ry1::DOUBLE AS y1
    FROM region QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY page, y0) = 1"""
)
def page_figures(spark, sf):
    """Order lines as pages with one caption; artwork under two captions of three, the
    first page that has some giving a number's figure."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    first = merge.best_rows(li, ["l_orderkey", "l_linenumber"], F.struct("l_partkey", "l_quantity"), "first")
    number = F.col("l_linenumber") % 3 + F.col("l_partkey") % 40
    caps = first.select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), F.lit(1).alias("block_ord"), "l_partkey",
        F.concat(F.lit("Figure "), number, F.lit(": view")).alias("text"), F.lit(60.0).alias("x0"), (F.col("l_quantity") + 100).alias("y0"), F.lit(200.0).alias("x1"), (F.col("l_quantity") + 112).alias("y1"),
    )
    shapes = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("s"), F.lit(h).alias("h")) for s, h in ((0, 60.0), (30, 200.0), (700, 20.0))])).alias("d")
    art = caps.where("l_partkey % 3 <> 0").select("doc_id", "page", "y1", shapes).select(
        "doc_id", "page", (F.col("d.s") + 80).alias("x0"), (F.col("y1") + 10 + F.col("d.s")).alias("y0"), (F.col("d.s") + 230).alias("x1"), (F.col("y1") + 10 + F.col("d.s") + F.col("d.h")).alias("y1")
    )
    pages = caps.select("doc_id", "page", F.lit(500.0).alias("width"), F.lit(842.0).alias("height"))
    return figure_regions(pages, caps.drop("l_partkey"), art).select("doc_id", "number", "page", "file_name", "x0", "y0", "x1", "y1")


# -- work queues, review and failing rows ---------------------------------------------------

@query(
    """WITH work AS (SELECT doc_id AS id FROM documents), done AS (SELECT vec_id AS id FROM embeddings), bad AS (SELECT doc_id AS id FROM labels WHERE quality = 0)
    SELECT 'new' AS mode, id FROM work WHERE id NOT IN (FROM done) UNION ALL SELECT 'retry', id FROM work WHERE id IN (FROM bad) AND id NOT IN (FROM done)
    UNION ALL SELECT 'overwrite', id FROM work UNION ALL SELECT 'overwrite-retry', id FROM work WHERE id IN (FROM bad)"""
)
def work_queues(spark, sf):
    work = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    done = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    failed = table(spark, sf, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    return union_all([merge.queue(work, done, failed, mode).select(F.lit(mode).alias("mode"), "id") for mode in ("new", "retry", "overwrite", "overwrite-retry")])


@query("SELECT p_partkey AS id, p_size <= 40 AS open FROM part")
def undescribed_rows(spark, sf):
    text = F.when(F.col("p_size") > 40, F.concat("p_name", F.lit("\n\n## Description\n\nDrawn."))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), undescribed(text).alias("open"))


@query("SELECT p_brand || '/figure-' || p_partkey AS key FROM part WHERE p_size % 5 <> 0 AND p_partkey IN (SELECT ps FROM (SELECT l_partkey AS ps FROM lineitem WHERE l_quantity > 45))")
def reviewable_descriptions(spark, sf):
    p, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    image = F.concat(F.lit("figure-"), "p_partkey")
    descriptions = p.select(F.col("p_brand").alias("corpus"), image.alias("image"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_name")).alias("description"))
    there = p.join(li.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select(F.col("p_brand").alias("corpus"), image.alias("image"))
    return review.reviewable(descriptions, there).select("key")


@query("SELECT doc_id AS id, length(text) % 3 <> 0 AS ok, CASE WHEN length(text) % 3 <> 0 THEN CAST(length(text) AS VARCHAR) END AS value, CASE WHEN length(text) % 3 = 0 THEN 'ValueError: refused' END AS error, CASE WHEN length(text) % 3 = 0 THEN 2 ELSE 1 END AS attempts FROM documents")
def failing_rows(spark, sf):
    """A model that refuses some texts: failures are rows, the job goes on."""

    def load_model():
        def model(text):
            if len(text) % 3 == 0:
                raise ValueError("refused")
            return str(len(text))

        return model

    judged = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), guarded(load_model, attempts=2)(F.col("text")).alias("r"))
    good, bad = split_results(judged, "r")
    return union_all([good.select("id", "r.*"), bad.select("id", "r.*")])


@query(
    """SELECT p_partkey AS id FROM part WHERE (p_size % 10 = 0 OR p_size % 10 IN (2, 9)) AND (p_partkey % 3 = 0 OR p_partkey % 7 = 1)
    AND (p_size % 4 = 0 OR p_size % 8 = 3)"""
)
def applicable_rows(spark, sf):
    """Parts that apply to classes 2 or 9, to NSW, and to climate zone 3; a part without
    an entry applies everywhere."""
    p = table(spark, sf, "part")
    rows = p.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") % 10 != 0, F.array((F.col("p_size") % 10).cast("string"), F.lit("1b"))).alias("building_classes"),
        F.when(F.col("p_partkey") % 3 != 0, F.array(F.when(F.col("p_partkey") % 7 == 1, "NSW").otherwise("VIC"))).alias("jurisdictions"),
        F.when(F.col("p_size") % 4 != 0, F.array((F.col("p_size") % 8).cast("int"))).alias("climate_zones"),
    )
    return applicable(rows, classes=("2", "9"), jurisdictions=("NSW",), zones=(3,)).select("id")


@query("SELECT c_custkey AS qid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def evaluation_resume(spark, sf):
    """Customers as questions, their orders as runs; a finished order is a success."""
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("qid"))
    runs = table(spark, sf, "orders").select(F.col("o_custkey").alias("qid"), F.when(F.col("o_orderstatus") == "F", 200).otherwise(500).alias("status"))
    return evaluation.still_to_run(asked, runs)


@query("SELECT p_partkey AS id, CASE WHEN p_size % 5 = 0 THEN 8 WHEN p_size % 5 = 1 THEN 1 END AS dims FROM part")
def reembedded_rows(spark, sf):
    """Rows whose text changed get new vectors, all others keep what they have."""
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.lit(None).cast("string").alias("heading"), F.when(F.col("p_size") % 5 == 1, F.array(F.lit(1.0).cast("float"))).alias("embedding"))
    changed = p.where("p_size % 5 = 0").select(F.col("p_partkey").alias("id"))
    return reembed(rows, changed, hashed_embedding(8), "hashed", 8).select("id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dims"))
