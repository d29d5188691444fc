"""Scans and sinks, checked by reading back what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import SP, store_period, table
from ..functions import text as T
from ..operators import corpus as C, ledger as L
from ..registry import query
from ..sources import files as S, publication as U

ORDER = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _exported(spark, d):
    """Orders written as CSV into the shared folder, with two columns that an upload
    must not keep."""
    path = S.fresh_path(spark, "csv")
    out = S.canonical_cells(table(spark, d, "orders").select(*ORDER)).withColumns({"_comment": F.lit("x"), "_internal": F.lit("y")})
    out.write.csv(path, header=True)
    return path


@query("src1_csv_scan", "SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DOUBLE) AS o_totalprice, o_orderpriority, false AS corrupt FROM orders")
def src1(spark, d):
    df = S.read_csv(spark, _exported(spark, d), [*ORDER, *S.IGNORED])
    return df.select(F.col("o_orderkey").try_cast("bigint").alias("o_orderkey"), "o_orderstatus", F.col("o_totalprice").try_cast("double").alias("o_totalprice"), "o_orderpriority", F.col("_corrupt").isNotNull().alias("corrupt"))


@query("src2_upload_scan", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def src2(spark, d):
    return S.read_upload(spark, _exported(spark, d), [*ORDER, *S.IGNORED]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("src3_physical_rows", "SELECT CAST(count(*) AS BIGINT) AS n_rows, count(*) FILTER (o_orderkey % 17 = 3) AS n_wrong_width FROM orders")
def src3(spark, d):
    """Rows of files in which some rows have a cell too many."""
    path = S.fresh_path(spark, "csv")
    cells = S.canonical_cells(table(spark, d, "orders").select(*ORDER))
    more = F.when(F.col("o_orderkey").cast("bigint") % 17 == 3, "x,y").otherwise(F.col("o_orderpriority"))
    cells.select(F.concat_ws(",", *ORDER[:-1], more)).write.text(path)
    return S.physical_rows(spark, path, len(ORDER)).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_wrong_width").alias("n_wrong_width"))


@query("src4_contract_registry", """SELECT r_name AS registry, CASE WHEN n_nationkey % 7 = 1 THEN 'twice' ELSE n_name END AS dataset_id, concat_ws('; ', CASE WHEN n_nationkey % 7 = 1 AND count(*) OVER (PARTITION BY r_name, n_nationkey % 7) > 1 THEN 'repeated dataset' END, CASE n_nationkey % 7 WHEN 2 THEN 'grain' WHEN 3 THEN 'no keys' WHEN 4 THEN 'key is no field' WHEN 5 THEN 'repeated field' END) AS errors
FROM nation JOIN region ON r_regionkey = n_regionkey""")
def src4(spark, d):
    """Registries of dataset contracts, one JSON file of several lines for each region,
    read with a fixed schema and checked; a fault of each kind is in some."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    kind = lambda i: F.col("n_nationkey") % 7 == i
    keys = F.when(kind(3), F.array().cast("array<string>")).when(kind(4), F.array(F.lit("rank"))).otherwise(F.array(F.lit("store_id")))
    fields = F.when(kind(5), F.array(F.lit("store_id"), F.lit("store_id"))).otherwise(F.array(F.lit("store_id"), F.lit("amount")))
    one = F.struct(F.when(kind(1), "twice").otherwise(F.col("n_name")).alias("dataset_id"), F.when(kind(2), "weekly").otherwise("store_period").alias("grain"), keys.alias("key_fields"), fields.alias("fields"))
    whole = n.groupBy(F.col("r_name").alias("registry")).agg(F.collect_list(one).alias("datasets"))
    path = S.fresh_path(spark, "contracts")
    whole.select(F.to_json(F.struct("registry", "datasets"), {"pretty": "true"}).alias("value"), "registry").write.partitionBy("registry").text(path)
    schema = "registry string, datasets array<struct<dataset_id:string,grain:string,key_fields:array<string>,fields:array<string>>>"
    read = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return L.contract_errors(read, ["store_period", "ranked"])


@query("src5_report_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l GROUP BY 1")
def src5(spark, d):
    lines = S.numbered_lines(table(spark, d, "documents"), "doc_id", "text")
    return lines.groupBy("doc_id").agg(F.max("line_no").cast("bigint").alias("n_lines"), F.sum(F.char_length("line")).alias("n_chars"))


@query("src6_fact_scan", f"WITH {SP} SELECT 'fact' AS kind, count(*) AS n FROM sp UNION ALL SELECT 'question', count(*) FROM benchmark")
def src6(spark, d):
    path = S.fresh_path(spark, "facts")
    store_period(spark, d).select(F.to_json(F.struct("store_id", "period_month", "transaction_amount")).alias("value")).write.text(path)
    facts = spark.read.schema("store_id string, period_month string, transaction_amount double").json(path).select(F.lit("fact").alias("kind"), "store_id")
    q = table(spark, d, "benchmark").select(F.lit("question").alias("kind"), F.col("text").alias("store_id"))
    return facts.unionByName(q).groupBy("kind").agg(F.count("*").alias("n"))


#: Parts of one dictionary file.
DICTIONARY = 200
ABOUT = "This dictionary lists parts by key, with their name, brand and type; it has rows:"
_MARKDOWN = f"""p AS (SELECT *, p_partkey // {DICTIONARY} AS f, row_number() OVER (PARTITION BY p_partkey // {DICTIONARY} ORDER BY p_partkey) AS i,
 '| `' || p_partkey || '` | ' || p_name || ' | ' || p_brand || ' | ' || p_type || ' |' AS line FROM part),
t AS (SELECT 'dictionary=' || f AS source_file, count(*) AS n, '| key | name | brand | type |' || chr(10) || '|---|---|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY i) AS rows FROM p GROUP BY f),
n AS (SELECT source_file, 1 AS i, '{ABOUT} ' || n AS part FROM t UNION ALL SELECT source_file, 3, rows FROM t),
md AS (SELECT 'field_contract_row' AS doc_type, source_file, source_file || ':L' || (i + 8) AS doc_id, CAST(p_partkey AS VARCHAR) AS slot,
 'source_file: ' || source_file || chr(10) || 'line: ' || (i + 8) || chr(10) || 'slot: ' || p_partkey || chr(10) || 'content: ' || line AS text FROM p JOIN t ON source_file = 'dictionary=' || f
 UNION ALL SELECT 'field_contract_note', source_file, source_file || ':chunk:' || i, '', 'source_file: ' || source_file || chr(10) || 'chunk: ' || i || chr(10) || 'content:' || chr(10) || part FROM n WHERE length(part) >= 80)"""


def dictionaries(spark, d):
    """Markdown files of parts, written and read back: a heading, two paragraphs and a
    table each."""
    row = F.concat(F.lit("| `"), F.col("p_partkey").cast("string"), F.lit("` | "), F.concat_ws(" | ", "p_name", "p_brand", "p_type"), F.lit(" |"))
    parts = table(spark, d, "part").select(F.floor(F.col("p_partkey") / DICTIONARY).alias("dictionary"), "p_partkey", row.alias("line"))
    whole = parts.groupBy("dictionary").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("p_partkey", "line"))).alias("l"))
    lines = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    head = F.concat(F.lit(f"# Parts\n\n{ABOUT} "), F.col("n").cast("string"), F.lit("\n\nIn order.\n\n| key | name | brand | type |\n|---|---|---|---|\n"))
    path = S.fresh_path(spark, "dictionaries")
    whole.select(F.concat(head, lines).alias("value"), "dictionary").write.partitionBy("dictionary").text(path)
    return S.read_markdown(spark, path, r"dictionary=\d+")


@query("src6_markdown_scan", f"WITH {_MARKDOWN} SELECT doc_id, doc_type, source_file, slot, md5(text) AS h FROM md")
def src6_markdown(spark, d):
    """Field rows and notes of markdown files, with their line or paragraph."""
    files = dictionaries(spark, d)
    return C.units([], files).select("doc_id", "doc_type", "source_file", "slot", F.md5("text").alias("h"))


@query("src7_record_sink", f"WITH {SP} SELECT region_type AS publication_id, count(*) AS n, round(sum(transaction_amount), 1) AS amount FROM sp GROUP BY 1")
def src7(spark, d):
    path = S.fresh_path(spark, "records")
    S.write_records(store_period(spark, d).withColumnRenamed("region_type", "publication_id"), path, "publication_id", ["store_id", "period_start"])
    return spark.read.parquet(path).groupBy("publication_id").agg(F.count("*").alias("n"), F.round(F.sum("transaction_amount"), 1).alias("amount"))


@query("src8_csv_cells", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS quantity, coalesce(l_returnflag, '') AS flag FROM lineitem")
def src8(spark, d):
    li = table(spark, d, "lineitem")
    cells = S.canonical_cells(li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag")))
    return cells.withColumns({"l_orderkey": F.col("l_orderkey").cast("bigint"), "l_linenumber": F.col("l_linenumber").cast("int")})


@query("src9_fact_sink", f"WITH {SP} SELECT store_id, period_month, transaction_orders FROM sp")
def src9(spark, d):
    path = S.fresh_path(spark, "facts")
    store_period(spark, d).select("store_id", "period_month", "transaction_orders").write.json(path)
    return spark.read.schema("store_id string, period_month string, transaction_orders bigint").json(path)


@query("src10_vector_upsert", "WITH n AS (SELECT vec_id, label + 100 AS label FROM embeddings WHERE vec_id % 3 = 0), u AS (SELECT vec_id, label FROM n UNION ALL SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0) SELECT vec_id, CAST(label AS INT) AS label, sha1(concat_ws('|', 'vec', CAST(vec_id AS VARCHAR))) AS point_id FROM u")
def src10(spark, d):
    """A table of vectors, then a third of them again with other labels, each put in
    twice: the parts that the second load touches are written again, the others stay."""
    path = S.fresh_path(spark, "vectors")
    old = table(spark, d, "embeddings").select("vec_id", "label")
    new = old.where("vec_id % 3 = 0").withColumn("label", (F.col("label") + 100).cast("int"))
    for load in (old, new, new):
        U.upsert(load, path, ["vec_id"], "label", buckets=8)
    merged = U.read(spark, path, old.schema)
    return merged.select("vec_id", "label", F.sha1(F.concat_ws("|", F.lit("vec"), F.col("vec_id").cast("string"))).alias("point_id"))


@query("src11_registered_views", "SELECT kind, count(*) AS n, count(*) - count(DISTINCT k) AS n_repeated FROM (SELECT 'part' AS kind, p_partkey AS k FROM part UNION ALL SELECT 'supplier', s_suppkey FROM supplier UNION ALL SELECT 'line', l_orderkey FROM lineitem) GROUP BY kind")
def src11(spark, d):
    """A view of several datasets with each row's lineage, written and read back."""
    path = S.fresh_path(spark, "view")
    side = lambda n, k, kind: table(spark, d, n).select(F.lit(kind).alias("kind"), F.col(k).alias("k"), T.digest(F.lit(kind), k).alias("source_row"))
    side("part", "p_partkey", "part").unionByName(side("supplier", "s_suppkey", "supplier")).unionByName(side("lineitem", "l_orderkey", "line")).write.partitionBy("kind").parquet(path)
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("k")).alias("n_repeated"))


@query("src12_batch_listing", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50")
def src12(spark, d):
    """The second page of fifty batches, newest first."""
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(50).limit(50)


LABELS = ["STANDARD: everyday goods", "SMALL: small goods", "MEDIUM: mid-sized goods", "LARGE: large goods", "ECONOMY: low-priced goods"]


@query("src13_catalogue", """WITH r AS (SELECT l_partkey, count(*) AS n_receipts, string_agg(l_orderkey || '/' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber) AS receipts FROM lineitem GROUP BY 1)
SELECT p_brand AS kind, p_partkey AS id, CASE regexp_extract(p_type, '^[A-Z]+') WHEN 'STANDARD' THEN 'everyday goods' WHEN 'SMALL' THEN 'small goods' WHEN 'MEDIUM' THEN 'mid-sized goods' WHEN 'LARGE' THEN 'large goods' WHEN 'ECONOMY' THEN 'low-priced goods' END AS label, coalesce(n_receipts, 0) AS n_receipts, coalesce(receipts, '') AS receipts
FROM part LEFT JOIN r ON l_partkey = p_partkey""")
def src13(spark, d):
    """Parts with the labels of their field, read from label lines, and the receipts of
    each as one ordered list."""
    lines = spark.createDataFrame([(x,) for x in LABELS], "line string")
    labels = lines.select(F.regexp_extract("line", "^([A-Z]+): (.*)$", 1).alias("field"), F.regexp_extract("line", "^([A-Z]+): (.*)$", 2).alias("label"))
    r = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count("*").alias("n_receipts"), F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("l"))
    p = table(spark, d, "part").select(F.col("p_brand").alias("kind"), F.col("p_partkey").alias("id"), F.regexp_extract("p_type", "^[A-Z]+", 0).alias("field"))
    receipts = F.array_join(F.transform("l", lambda x: F.concat_ws("/", x.l_orderkey.cast("string"), x.l_linenumber.cast("string"))), ",")
    return p.join(labels, "field", "left").join(r, "id", "left").select("kind", "id", "label", F.coalesce("n_receipts", F.lit(0)).alias("n_receipts"), F.coalesce(receipts, F.lit("")).alias("receipts"))
