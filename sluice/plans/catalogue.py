"""Queries that apply the library to the given tables, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.config import Limits
from sluice.functions import cells as c
from sluice.functions.rules import RuleSet, consent_rules, error_text, integer, max_length, one_of, required, whole_number
from sluice.functions.status import is_terminal, status_label
from sluice.operators import assemble, chunking, lifecycle, messages, validate, views
from sluice.operators.search_index import NameIndex, last_place
from sluice.plans.bulk_import import FILE_KINDS, Imported, bulk_import
from sluice.sources.gates import verdicts
from sluice.sources.records import csv_records, without_blanks
from sluice.storage import delete, no_leftovers, passing, settings, short_listing, through_table, work_folder
from sluice.streaming.arrivals import table_stream, validate_stream
from sluice.streaming.barrier import barrier_stream
from sluice.streaming.counts import KeptCounts, counts_stream
from sluice.streaming.envelopes import Handler, dedup_stream, deliver_stream, deliver_with_retries, until_settled
from sluice.streaming.handled import HandledIds, once_stream
from sluice.streaming.imports import arriving_files, import_stream, imported
from sluice.streaming.stateful import STORE, guarded_barrier, lifecycle_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- parts as an import: rules, duplicates, chunks of 500 rows, outcome ---------------------------------------

PART_CHUNK = 500
PART_RULES = RuleSet(
    ("p_name", "p_size", "p_type"),
    (required("p_name"), max_length("p_name", 10), whole_number("p_size", 1, 40), one_of("p_type", "ECONOMY", "MEDIUM", "STANDARD", "SMALL", "LARGE")),
    lambda cells: F.struct(cells["p_name"].alias("name"), integer(cells["p_size"]).alias("size")),
)

PART_SQL = """
with numbered as (
  select p_partkey, trim(p_name) as p_name, p_size, p_type, row_number() over (order by p_partkey) - 1 as n from part
),
ruled as (
  select p_partkey, p_name, p_size, cast(n // 500 + 1 as int) as chunk_seq, cast(n % 500 + 1 as bigint) as row_in_chunk,
    concat_ws('; ',
      case when p_name = '' then 'p_name is required' end,
      case when length(p_name) > 10 then 'p_name is longer than 10 characters' end,
      case when not (p_size between 1 and 40) then 'p_size must be a whole number from 1 to 40' end,
      case when lower(p_type) not in ('economy', 'medium', 'standard', 'small', 'large') then 'p_type must be one of: ECONOMY, MEDIUM, STANDARD, SMALL, LARGE' end) as rule_text
  from numbered
),
firsts as (
  select *, min(case when rule_text = '' then row_in_chunk end) over (partition by chunk_seq, p_name, p_size, rule_text = '') as first_row from ruled
),
checked as (
  select p_partkey, chunk_seq, row_in_chunk,
    case when rule_text = '' and row_in_chunk > first_row then 'is a duplicate of row ' || first_row || ' of this chunk' else rule_text end as errors
  from firsts
)
"""


def part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of one import, in chunks."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.col("p_size").cast("string").alias("p_size"), "p_type")
    rows = part.select(
        F.lit("part").alias("import_id"), "p_partkey", F.array(*map(F.lit, PART_RULES.columns)).alias("header"), F.array("p_name", "p_size", "p_type").alias("cells")
    )
    return chunking.assign_by_rows(rows, ["import_id"], ["p_partkey"], PART_CHUNK)


def part_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate_rows(part_rows(spark, sf_dir), PART_RULES)


def part_chunks(checked: DataFrame) -> DataFrame:
    """Chunks with counts; the second one counts as failed."""
    counts = validate.chunk_counts(checked, ["import_id", "chunk_seq"])
    failed = F.col("chunk_seq") == 2
    status = F.when(failed, "failed").otherwise("completed")
    return counts.withColumns({"status": status, **{x: F.when(failed, 0).otherwise(F.col(x)).cast("long") for x in ("valid_rows", "invalid_rows")}})


@query(PART_SQL.split("firsts as")[0].rstrip().rstrip(",") + " select p_partkey, rule_text as errors from ruled")
def part_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_rows(spark, sf_dir)
    errors = validate.row_errors(F.col("header"), F.col("cells"), PART_RULES)
    return rows.select("p_partkey", error_text(errors).alias("errors"))


@query(PART_SQL + "select p_partkey, chunk_seq, row_in_chunk from checked where errors = ''")
def part_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.accepted(part_checked(spark, sf_dir)).select("p_partkey", "chunk_seq", "row_in_chunk")


@query(PART_SQL + "select p_partkey, chunk_seq, row_in_chunk, errors from checked where errors <> ''")
def part_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.rejected(part_checked(spark, sf_dir)).select("p_partkey", "chunk_seq", "row_in_chunk", error_text(F.col("errors")).alias("errors"))


@query(
    PART_SQL
    + """select chunk_seq, cast(count(*) filter (where errors = '') as bigint) as valid_rows,
    cast(count(*) filter (where errors <> '') as bigint) as invalid_rows from checked group by chunk_seq"""
)
def part_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.chunk_counts(part_checked(spark, sf_dir), ["chunk_seq"])


@query(
    PART_SQL
    + """select 'part' as id, 'completed_with_errors' as status,
    case when bool_or(chunk_seq <> 2) then 'consent/import-part/output/result.csv' end as output_object_key,
    case when bool_or(chunk_seq <> 2 and errors <> '') then 'consent/import-part/output/errors.csv' end as error_object_key,
    case when bool_or(chunk_seq = 2) then 'Chunks that could not be validated: 2' end as failure_message
    from checked"""
)
def part_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = part_chunks(part_checked(spark, sf_dir))
    imports = chunks.select(F.col("import_id").alias("id"), F.lit("consent/import-part/source/source.csv").alias("source_object_key")).distinct()
    return assemble.import_outcome(imports, chunks).drop("completed_at")


@query(PART_SQL + "select p_partkey, chunk_seq, row_in_chunk from checked where chunk_seq <> 2 and errors = ''")
def part_assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = through_table(part_checked(spark, sf_dir))
    return assemble.assemble_rows(checked, part_chunks(checked), validate.rejected(checked)).select("p_partkey", "chunk_seq", "row_in_chunk")


@query(PART_SQL + "select p_partkey, chunk_seq, row_in_chunk, errors from checked where chunk_seq <> 2 and errors <> ''")
def part_merge_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = through_table(part_checked(spark, sf_dir))
    merged = assemble.merge_errors(validate.rejected(checked), part_chunks(checked))
    return merged.select("p_partkey", "chunk_seq", "row_in_chunk", error_text(F.col("errors")).alias("errors"))


@query(PART_SQL + "select chunk_seq as sequence, cast(count(*) as bigint) as n_rows, 'consent/import-part/chunks/chunk-' || lpad(cast(chunk_seq as varchar), 6, '0') || '.csv' as source_object_key from checked group by chunk_seq")
def part_chunk_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_rows(spark, sf_dir).withColumn("source_object_key", F.lit("consent/import-part/source/source.csv"))
    counts = rows.groupBy("chunk_seq").agg(F.count("*").alias("n_rows"))
    return chunking.chunk_list(rows).join(counts, F.col("sequence") == F.col("chunk_seq")).select("sequence", "n_rows", "source_object_key")


@query(PART_SQL + "select chunk_seq as sequence, cast(count(*) filter (where errors = '') as bigint) as valid_rows from checked group by chunk_seq")
def chunk_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = validate.chunk_counts(part_checked(spark, sf_dir), ["import_id", "chunk_seq"])
    chunks = counts.select(F.col("import_id").alias("bulk_import_id"), F.col("chunk_seq").alias("sequence"), "valid_rows")
    return views.chunk_detail(chunks, "part").select("sequence", "valid_rows")


@query(PART_SQL + "select p_partkey, errors from checked")
def part_stream_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of parts as a stream of files, checked by batch; a chunk is whole in one file."""
    folder = work_folder(spark)
    part_rows(spark, sf_dir).repartition("chunk_seq").write.parquet(f"{folder}/in")
    stream = table_stream(spark, f"{folder}/in", files_per_trigger=2)
    validate_stream(stream, lambda rows: validate.validate_rows(rows, PART_RULES), f"{folder}/ok", f"{folder}/bad", f"{folder}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{folder}/ok").unionByName(spark.read.parquet(f"{folder}/bad"))
    return found.select("p_partkey", error_text(F.col("errors")).alias("errors"))


# --- lineitems: the first of each key ------------------------------------------------------------------------


@query("""
select l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() over (partition by l_orderkey, l_linenumber
  order by l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) > 1 as is_duplicate
from lineitem
""")
def lineitem_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rows of one chunk per order, their line number as the key."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"))
    rows = table(spark, sf_dir, "lineitem").withColumns({"row_in_chunk": place, "errors": F.array().cast("array<string>")})
    checked = validate.reject_duplicates(rows, ["l_orderkey"], F.col("l_linenumber"))
    return checked.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.size("errors") > 0).alias("is_duplicate"))


# --- documents: chunks by bytes, records, gates --------------------------------------------------------------


def import_file() -> Column:
    """The import that a document belongs to: a block of ids of its source, so that none grows with the table."""
    return F.concat(F.coalesce("source", F.lit("")), F.lit("-"), F.floor(F.col("doc_id") / 5000).cast("string")).alias("file")


@query("""
with recursive d as (
  select doc_id, coalesce(source, '') || '-' || doc_id // 5000 as file, cast(coalesce(octet_length(encode(text)), 0) as bigint) as n,
    row_number() over (partition by coalesce(source, '') || '-' || doc_id // 5000 order by doc_id) as rn from documents
),
walk as (
  select doc_id, file, rn, n as bytes, cast(1 as bigint) as rows, 1 as seq from d where rn = 1
  union all
  select d.doc_id, d.file, d.rn,
    case when w.rows >= 50 or w.bytes >= 20000 then d.n else w.bytes + d.n end,
    case when w.rows >= 50 or w.bytes >= 20000 then 1 else w.rows + 1 end,
    case when w.rows >= 50 or w.bytes >= 20000 then w.seq + 1 else w.seq end
  from walk w join d on d.file = w.file and d.rn = w.rn + 1
)
select doc_id, file, cast(seq as int) as chunk_seq, rows as row_in_chunk from walk
""")
def documents_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", import_file(), F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    return chunking.assign_chunks(docs, "file", "doc_id", "n", Limits(chunk_rows=50, chunk_bytes=20_000)).select("doc_id", "file", "chunk_seq", "row_in_chunk")


@query("""
select doc_id, cast((row_number() over (order by doc_id) - 1) // 100 + 1 as int) as chunk_seq,
  cast((row_number() over (order by doc_id) - 1) % 100 + 1 as bigint) as row_in_chunk from documents
""")
def documents_rows_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("import_id"), "doc_id")
    return chunking.assign_by_rows(docs, ["import_id"], ["doc_id"], 100).select("doc_id", "chunk_seq", "row_in_chunk")


@query("select doc_id, coalesce(text, '') as text from documents")
def documents_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{work_folder(spark)}/csv"
    docs.select(c.join_cells(F.array(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")))).alias("record")).write.text(folder)
    return csv_records(spark, folder).select(F.col("cells")[0].cast("long").alias("doc_id"), F.col("cells")[1].alias("text"))


@query("""
with p as (select doc_id, unnest(string_split_regex(coalesce(text, ''), '[,\\n]')) as cell, generate_subscripts(string_split_regex(coalesce(text, ''), '[,\\n]'), 1) as n from documents),
q as (select doc_id, n, regexp_replace(regexp_replace(cell, '[ \\t\\x0B\\f\\r]+$', ''), '^[ \\t\\x0B\\f\\r]+', '') as cell from p)
select doc_id, cast(n as bigint) as n, replace(cell, ' ', '" ') as cell, regexp_matches(cell, '^"') as quoted from q
""")
def documents_bare_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of all texts between commas and line ends, with a quote behind each word, written without quotes around them where none is first."""
    folder = f"{work_folder(spark)}/bare"
    parts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "[,\n]", -1)).alias("n", "cell"))
    parts = parts.withColumn("cell", F.regexp_replace(F.regexp_replace("cell", "[ \\t\\x0B\\f\\r]+\\z", ""), "^[ \\t\\x0B\\f\\r]+", ""))
    cell, quoted = F.replace("cell", F.lit(" "), F.lit('" ')), F.startswith("cell", F.lit('"'))
    written = F.when(quoted, c.join_cells(F.array(cell))).otherwise(cell)
    parts.select(F.concat_ws(",", F.col("doc_id").cast("string"), (F.col("n") + 1).cast("string"), written, quoted.cast("string")).alias("record")).write.text(folder)
    cells = lambda i, kind: F.try_element_at("cells", F.lit(i)).cast(kind)
    return csv_records(spark, folder).select(cells(1, "long").alias("doc_id"), cells(2, "long").alias("n"), cells(3, "string").alias("cell"), cells(4, "boolean").alias("quoted"))


@query("select doc_id, line from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) where regexp_matches(line, '[^ \\t\\n\\r\\x00\\x0b]')")
def documents_lines_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of all texts as records of one cell, without blank ones."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return without_blanks(lines.withColumn("cells", F.array("line", F.lit("")))).select("doc_id", "line")


@query("""
select doc_id, cast(coalesce(length(text), 0) as bigint) as chars, cast(coalesce(octet_length(encode(text)), 0) as bigint) as bytes,
  concat_ws('; ', case when coalesce(text, '') = '' then 'text is required' end, case when length(text) > 2000 then 'text is longer than 2000 characters' end) as errors,
  coalesce(octet_length(encode(text)), 0) + 1 > 16384 as too_large
from documents
""")
def documents_length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, cells = table(spark, sf_dir, "documents"), {"text": F.col("text")}
    rules = RuleSet(("text",), (required("text"), max_length("text", 2000)), lambda x: x["text"])
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return docs.select(
        "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"), size.cast("long").alias("bytes"),
        error_text(rules.errors(cells)).alias("errors"), (size + 1 > Limits().record_bytes).alias("too_large"),
    )


def _as_files(rows: DataFrame, header: list[str], folder: str) -> DataFrame:
    """Writes rows (file, n, record) as one delimited file each, header first; returns path and file."""
    heads = rows.select("file").distinct().select("file", F.lit(-1).cast("long").alias("n"), c.join_cells(F.array(*map(F.lit, header))).alias("record"))
    ordered = heads.unionByName(rows).repartition("file").sortWithinPartitions("file", "n")
    with no_leftovers(rows.sparkSession):
        ordered.select("file", "record").write.partitionBy("file").text(folder)
    with short_listing(rows.sparkSession):
        files = rows.sparkSession.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    return files.withColumn("file", F.regexp_extract("path", "file=([^/]*)/", 1))


@query("""
with r as (
  select coalesce(source, '') || '-' || doc_id // 5000 as file, coalesce(source, '') as source, row_number() over (partition by coalesce(source, ''), doc_id // 5000 order by doc_id) + 1 as record_no,
    octet_length(encode(doc_id || ',' || case when regexp_matches(text, '[",\\s\\\\]') then '"' || replace(text, '"', '""') || '"' else coalesce(text, '') end)) + 1 as n
  from documents
),
f as (select file, source, 12 + sum(n) as bytes, min(case when n > 16384 then record_no end) as large from r group by file, source),
v as (
  select file, case when try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 5 = 0 then 'it is not a .csv file' when bytes > 400 * 1024 then 'it is larger than 400 KB'
    when large is not null then 'row ' || large || ' is larger than 16 KB, which usually means a quote is never closed' end as reason from f
)
select file, case when reason is null then 'queued' else 'failed' end as status, 'The file is not processable: ' || reason || '.' as failure_message from v
""")
def documents_file_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files, each checked before it is read."""
    folder = f"{work_folder(spark)}/files"
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(import_file(), F.col("doc_id").alias("n"), c.join_cells(F.array(F.col("doc_id").cast("string"), "text")).alias("record"))
    files = _as_files(rows, ["doc_id", "text"], folder)
    ending = F.when(F.regexp_extract("file", "([0-9]+)-", 1).try_cast("int") % 5 == 0, ".txt").otherwise(".CSV")
    imports = files.withColumn("original_filename", F.concat("file", ending)).withColumn("path", F.regexp_replace("path", "^file:/+", "file:///"))
    found = verdicts(spark, imports, folder, ("doc_id", "text"), Limits(file_bytes=400 * 1024))[0]
    return found.select("file", "status", "failure_message")


CONSENT_LIMITS = Limits(chunk_rows=20, record_bytes=1 << 30, file_bytes=1 << 50, chunk_bytes=1 << 50)

CONSENT_SQL = """
with d as (
  select coalesce(source, '') || '-' || doc_id // 5000 as file, doc_id, row_number() over (partition by coalesce(source, ''), doc_id // 5000 order by doc_id) - 1 as n, 'D' || (doc_id % 7) as code,
    trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(11)) as name, lang as purpose, n_chars % 3 as version,
    case doc_id % 4 when 0 then 'Active' when 1 then 'INACTIVE' when 2 then ' active ' else 'x' end as status
  from documents
),
r as (
  select file, doc_id, cast(n // 20 + 1 as int) as chunk_seq, cast(n % 20 + 1 as bigint) as row_in_chunk, code, version,
    concat_ws('; ', case when name = '' then 'Consent name is required' end, case when length(name) > 255 then 'Consent name is longer than 255 characters' end,
      case when coalesce(purpose, '') = '' then 'Purpose is required' end, case when version < 1 then 'Version must be a positive whole number' end,
      case when status = 'x' then 'Status must be one of: Active, Inactive' end) as rule_text
  from d
),
f as (select *, min(case when rule_text = '' then row_in_chunk end) over (partition by file, chunk_seq, code, version, rule_text = '') as first_row from r),
x as (select file, doc_id, chunk_seq, row_in_chunk,
  case when rule_text = '' and row_in_chunk > first_row then 'is a duplicate of row ' || first_row || ' of this chunk' else rule_text end as errors
from f)
"""
#: Every third chunk counts as one whose attempts are used up.
STATE_SQL = """,
k as (select file, chunk_seq, chunk_seq % 3 = 2 as failed, cast(count(*) filter (where errors = '') as bigint) as valid, cast(count(*) filter (where errors <> '') as bigint) as invalid,
  'consent/import-' || file || '/chunks/chunk-' || lpad(cast(chunk_seq as varchar), 6, '0') || '.csv' as key from x group by 1, 2),
s as (select file, chunk_seq, key, case when failed then 'failed' else 'completed' end as status, cast(case when failed then 0 else valid end as bigint) as valid_rows,
  cast(case when failed then 0 else invalid end as bigint) as invalid_rows, case when failed then 'no attempt is left' end as failure_message from k)
"""


def consent_rows(docs: DataFrame) -> DataFrame:
    """Documents as consent records (file, n, record), whole texts as names."""
    status = F.element_at(F.array(*map(F.lit, ("Active", "INACTIVE", " active ", "x"))), (F.col("doc_id") % 4 + 1).cast("int"))
    cells = F.array(
        F.concat(F.lit("D"), (F.col("doc_id") % 7).cast("string")), F.coalesce("text", F.lit("")), F.lit(""), F.coalesce("lang", F.lit("")),
        (F.col("n_chars") % 3).cast("string"), status, F.col("doc_id").cast("string"),
    )
    return docs.select(import_file(), F.col("doc_id").alias("n"), c.join_cells(cells).alias("record"))


def consent_imports(files: DataFrame) -> DataFrame:
    """The imports of files (path, in a folder named after the file)."""
    file = F.regexp_extract("path", "file=([^/]*)/", 1)
    key = F.concat(F.lit("consent/import-"), file, F.lit("/source/source.csv"))
    return files.select(file.alias("id"), "path", F.concat(file, F.lit(".csv")).alias("original_filename"), key.alias("source_object_key"))


def consent_import(spark: SparkSession, sf_dir: str, lost: bool = False) -> Imported:
    """The whole import over files of consent records, one per file of documents; they go once they are read."""
    folder = f"{work_folder(spark)}/imports"
    docs = table(spark, sf_dir, "documents")
    imports = consent_imports(_as_files(consent_rows(docs), [*consent_rules().columns, "doc_id"], folder))
    given_up = None
    if lost:
        most = docs.groupBy(import_file()).count().select(F.col("file").alias("import_id"), F.explode(F.sequence(F.lit(1), F.ceil(F.col("count") / CONSENT_LIMITS.chunk_rows).cast("int"))).alias("chunk_seq"))
        given_up = most.where("chunk_seq % 3 = 2").withColumn("reason", F.lit("no attempt is left"))
    return bulk_import(spark, imports, folder, consent_rules(CONSENT_LIMITS), CONSENT_LIMITS, given_up=given_up, when_read=lambda: delete(spark, folder))


@query(CONSENT_SQL + "select * from x")
def documents_bulk_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole import, files to checked rows."""
    done = consent_import(spark, sf_dir)
    return done.rows.select(F.col("import_id").alias("file"), F.col("cells")[6].cast("long").alias("doc_id"), "chunk_seq", "row_in_chunk", error_text(F.col("errors")).alias("errors"))


@query(CONSENT_SQL + "select * from x")
def documents_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The imports of files that arrive in three lots, each lot a run of one stream."""
    folder = work_folder(spark)
    rows = consent_rows(table(spark, sf_dir, "documents"))
    for lot in range(3):
        _as_files(rows.where(F.pmod(F.xxhash64("file"), F.lit(3)) == lot), [*consent_rules().columns, "doc_id"], f"{folder}/in/lot-{lot}")
        import_stream(arriving_files(spark, f"{folder}/in"), consent_imports, f"{folder}/out", f"{folder}/log", consent_rules(CONSENT_LIMITS), CONSENT_LIMITS).awaitTermination()
    done = imported(spark, f"{folder}/out", "rows")
    return done.select(F.col("import_id").alias("file"), F.col("cells")[6].cast("long").alias("doc_id"), "chunk_seq", "row_in_chunk", error_text(F.col("errors")).alias("errors"))


@query(
    CONSENT_SQL
    + STATE_SQL
    + """, o as (
  select key, chunk_seq, row_in_chunk, doc_id, null as errors from x join s using (file, chunk_seq)
  union all select replace(key, '/chunks/', '/errors/'), chunk_seq, row_in_chunk, doc_id, errors from x join s using (file, chunk_seq) where status <> 'failed' and errors <> ''
  union all select 'consent/import-' || file || '/output/errors.csv', chunk_seq, row_in_chunk, doc_id, errors from x join s using (file, chunk_seq) where status <> 'failed' and errors <> ''
  union all select 'consent/import-' || file || '/output/result.csv', chunk_seq, row_in_chunk, doc_id, null from x join s using (file, chunk_seq) where status <> 'failed' and errors = ''
),
h as (select distinct key from o union select distinct 'consent/import-' || file || '/output/result.csv' from s where status <> 'failed')
select key, row_number() over (partition by key order by chunk_seq, row_in_chunk) + 1 as record_no, cast(doc_id as varchar) as doc_id, errors from o
union all select key, 1, 'doc_id', case when contains(key, 'errors') then 'Errors' end from h"""
)
def documents_import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of the imports, read back: chunks, rejected rows by chunk, results and merged errors, headers included.

    Files of one kind are written and read back before those of the next, and go once they are read.
    """
    key = F.regexp_extract("path", "(consent/import-.*)$", 1)
    errors = F.contains(key, F.lit("errors"))
    # rejected rows have chunk and row before their cells and the messages after them
    doc = F.try_element_at("cells", F.when(errors, 9).otherwise(7))
    asked = (key.alias("key"), F.col("record_no").cast("long").alias("record_no"), doc.alias("doc_id"), F.when(errors, F.try_element_at("cells", F.lit(10))).alias("errors"))
    found = []
    with passing(spark) as kept:
        done = consent_import(spark, sf_dir, lost=True)
        for kind in FILE_KINDS:
            folder = work_folder(spark)
            done.write(folder, (kind,))
            found.append(csv_records(spark, folder, columns=asked))
            delete(spark, folder)
        return kept(reduce(DataFrame.unionByName, found))


@query(CONSENT_SQL + STATE_SQL + "select key, status, valid_rows, invalid_rows, case when invalid_rows > 0 then replace(key, '/chunks/', '/errors/') end as error_object_key, failure_message from s")
def documents_chunk_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk with its counts; of every three one whose attempts are used up."""
    chunks = consent_import(spark, sf_dir, lost=True).chunks
    return chunks.select(F.col("source_object_key").alias("key"), "status", "valid_rows", "invalid_rows", "error_object_key", "failure_message")


@query(
    CONSENT_SQL
    + STATE_SQL
    + """, m as (select file as id, case when bool_or(status = 'failed' or invalid_rows > 0) then 'completed_with_errors' else 'completed' end as status,
  case when bool_or(status <> 'failed') then 'consent/import-' || file || '/output/result.csv' end as output_object_key,
  case when bool_or(invalid_rows > 0) then 'consent/import-' || file || '/output/errors.csv' end as error_object_key,
  'Chunks that could not be validated: ' || string_agg(cast(chunk_seq as varchar), ', ' order by chunk_seq) filter (where status = 'failed') as message
from s group by file)
select * replace (case when length(message) > 1000 then rtrim(substr(message, 1, 1000), ' ') || '...' else message end as message), true as is_completed from m"""
)
def documents_import_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of every import, with failed chunks named."""
    imports = consent_import(spark, sf_dir, lost=True).imports
    return imports.select("id", "status", "output_object_key", "error_object_key", F.col("failure_message").alias("message"), F.col("completed_at").isNotNull().alias("is_completed"))


@query(
    CONSENT_SQL
    + STATE_SQL
    + """select file as bulk_import_id, 'consent.chunk.validate' as routing_key, key as chunk_object_key from s
union all select distinct file, 'consent.import.assemble', null from s"""
)
def documents_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the imports ask for: each chunk to be validated, each import to be assembled."""
    requests = consent_import(spark, sf_dir, lost=True).requests
    return requests.select("bulk_import_id", "routing_key", F.get_json_object("payload", "$.chunk_object_key").alias("chunk_object_key"))


HEADERS = ("doc_id,text", "text, Doc_ID ,lang", "doc_id,,text", "doc_id,text,DOC_ID", "doc_id,lang", ",", "lang,source", "﻿doc_id,text")
REASONS_SQL = """case i when 2 then 'column 2 of the header has no name' when 3 then 'the header has the column [DOC_ID] twice' when 4 then 'the header is missing the column(s) [text]'
  when 5 then 'it has no header row' when 6 then 'the header is missing the column(s) [doc_id, text]' else case when filled = 0 then 'it has no data rows' end end"""


@query(
    """with f as (select coalesce(source, '') as file, count(*) filter (where regexp_matches(coalesce(lang, '') || coalesce(source, ''), '[^ \\t\\n\\r\\x00\\x0b]')) as filled from documents group by 1),
n as (select *, (row_number() over (order by encode(file)) - 1) % """
    + f"{len(HEADERS)} as i from f) select file, {REASONS_SQL} as reason from n"
)
def documents_header_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per source with lang and source of its documents, under one of several headers, most of them wrong."""
    folder = f"{work_folder(spark)}/headers"
    docs = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("file"), F.col("doc_id").alias("n"), c.join_cells(F.array("lang", "source")).alias("record"))
    nth = (F.row_number().over(Window.orderBy(F.encode("file", "UTF-8"))) - 1) % len(HEADERS) + 1  # a row per source
    header = F.element_at(F.array(*map(F.lit, HEADERS)), nth.cast("int"))
    heads = docs.select("file").distinct().select("file", F.lit(-1).cast("long").alias("n"), header.alias("record"))
    docs.unionByName(heads).withColumn("file", F.concat(F.lit("s"), "file")).repartition("file").sortWithinPartitions("file", "n").select("file", "record").write.partitionBy("file").text(folder)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_replace("path", "^file:/+", "file:///").alias("path"))
    imports = files.withColumn("original_filename", F.lit("x.csv")).withColumn("file", F.regexp_extract("path", "file=s([^/]*)/", 1))
    return verdicts(spark, imports, folder, ("doc_id", "text"))[0].select("file", "reason")


@query("""
select doc_id, 'consent/import-' || source || '/chunks/chunk-' || lpad(cast(doc_id % 1000 as varchar), 6, '0') || '.csv' as chunk_key,
  'consent/import-' || source || '/errors/chunk-' || lpad(cast(doc_id % 1000 as varchar), 6, '0') || '.csv' as error_key,
  'consent/import-' || source || '/output/result.csv' as result_key,
  case when doc_id % 3 = 0 then 'import' else source || '.part' end || '-rejected-rows.csv' as download,
  case when length(text) > 1000 then rtrim(substr(text, 1, 1000), ' ') || '...' else text end as message,
  case when n_chars <= 921 then n_chars || ' B' else cast(cast(round(n_chars / 1024.0) as bigint) as varchar) || ' KB' end as size_text
from (select * replace (coalesce(source, '') as source) from documents)
""")
def paths_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("")))
    source_key = F.concat(F.lit("consent/import-"), "source", F.lit("/source/source.csv"))
    chunk = c.chunk_key(source_key, F.col("doc_id") % 1000)
    name = F.when(F.col("doc_id") % 3 == 0, F.lit(".csv")).otherwise(F.concat("source", F.lit(".part.csv")))
    return docs.select(
        "doc_id", chunk.alias("chunk_key"), c.error_key(chunk).alias("error_key"), c.output_key(source_key, "result.csv").alias("result_key"),
        c.download_name(name, "rejected-rows").alias("download"), c.limited(F.col("text")).alias("message"), c.file_size(F.col("n_chars")).alias("size_text"),
    )


# --- orders as imports, lineitems as their chunks -------------------------------------------------------------

ORDER_STATUS = {"F": "completed", "O": "validating", "P": "parsing"}
ORDER_STATUS_SQL = "case o_orderstatus when 'F' then 'completed' when 'O' then 'validating' when 'P' then 'parsing' end"


def order_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*(F.lit(x) for pair in ORDER_STATUS.items() for x in pair))[F.col("o_orderstatus")]
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), status.alias("status"), F.col("o_orderpriority").alias("original_filename"), F.col("o_orderdate").alias("created_at")
    )


def order_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    finished = F.when(F.col("l_linestatus") == "F", "completed").otherwise("processing")
    whole = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("bulk_import_id"), F.col("l_linenumber").alias("sequence"), finished.alias("status"), whole.alias("valid_rows"), (whole % 3).alias("invalid_rows")
    )


ORDERS_SQL = f"""
with i as (select o_orderkey, {ORDER_STATUS_SQL} as status from orders),
k as (select l_orderkey, cast(count(*) as bigint) as t, cast(count(*) filter (where l_linestatus = 'F') as bigint) as f,
  cast(sum(cast(l_quantity as bigint)) as bigint) as v, cast(sum(cast(l_quantity as bigint) % 3) as bigint) as r from lineitem group by 1),
j as (select i.*, coalesce(t, 0) as t, coalesce(f, 0) as f, coalesce(v, 0) as v, coalesce(r, 0) as r from i left join k on o_orderkey = l_orderkey)
"""


@query(
    ORDERS_SQL
    + """select o_orderkey as id, status, case status when 'completed' then 'Completed' when 'validating' then 'Validating' when 'parsing' then 'Splitting file' end as label,
    t as chunks_total, f as chunks_finished, cast(case status when 'completed' then 100 when 'parsing' then 5
      when 'validating' then 10 + case when t > 0 then (160 * f + t) // (2 * t) else 0 end end as int) as progress, status = 'completed' as terminal from j"""
)
def orders_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = views.with_chunk_counts(order_imports(spark, sf_dir), order_chunks(spark, sf_dir))
    out = lifecycle.with_progress(counted).withColumns({"label": status_label(F.col("status")), "terminal": is_terminal(F.col("status"))})
    return out.select("id", "status", "label", "chunks_total", "chunks_finished", "progress", "terminal")


@query(ORDERS_SQL + "select o_orderkey as id, v as valid_rows, r as rejected_rows, f || ' of ' || t as chunks_progress from j")
def orders_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.summary(order_imports(spark, sf_dir), order_chunks(spark, sf_dir)).select("id", "valid_rows", "rejected_rows", "chunks_progress")


@query("""
with o as (select o_custkey from orders group by 1 order by count(*) desc, 1 limit 1)
select o_orderkey as id, o_orderpriority as original_filename, cast(row_number() over (order by o_orderdate desc, o_orderkey) as int) as place
from orders where o_custkey = (select o_custkey from o) and contains(lower(o_orderpriority), 'o')
""")
def orders_owned_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The imports of the customer who has most, in the order of the list."""
    imports = order_imports(spark, sf_dir)
    owner = imports.groupBy("user_id").count().orderBy(F.desc("count"), "user_id").first()
    found = views.search(views.owned(imports, owner["user_id"] if owner else -1), "O")
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc("created_at"), "id"))).select("id", "original_filename", "place")


@query("""
with i as (select p_partkey as id, p_name || ' ' || p_type || ' ' || p_partkey || '.csv' as original_filename, timestamp '2026-01-01' + interval (p_size) day as created_at from part),
f as (select *, row_number() over (order by created_at desc, id) as place from i where contains(lower(original_filename), 'mal'))
select id, original_filename, cast((place - 1) // 20 + 1 as int) as page, cast((place - 1) % 20 + 1 as int) as place from f where place <= 60
""")
def part_search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three pages of the parts whose name contains a word, each going on where the last one ended."""
    name = F.concat_ws(" ", "p_name", "p_type", F.concat(F.col("p_partkey").cast("string"), F.lit(".csv")))
    created = (F.lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.col("p_size"))).alias("created_at")
    imports = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("original_filename"), created)
    index = NameIndex(f"{work_folder(spark)}/names")
    index.build(imports)
    pages, after = [], None
    for n in range(1, 4):
        rows = index.page(imports, "MAL", 20, after).collect()  # a page
        pages += [(r["id"], r["original_filename"], n, i + 1) for i, r in enumerate(rows)]
        after = last_place(rows)
        if after is None:
            break
    return spark.createDataFrame(pages, "id long, original_filename string, page int, place int")


@query(ORDERS_SQL + "select o_orderkey as bulk_import_id, 'consent.import.assemble' as routing_key from j where status = 'validating' and t > 0 and t = f")
def orders_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.completion(order_imports(spark, sf_dir), order_chunks(spark, sf_dir))


@query("""
with k as (select l_orderkey, l_linenumber, bool_or(l_linestatus = 'F') as f from lineitem group by 1, 2)
select l_orderkey as bulk_import_id, cast(count(*) as bigint) as chunks from k group by 1 having bool_and(f)
""")
def lineitem_barrier_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines arrive as chunk states in two lots, each a run of one stream; one request per order whose lines are all finished."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(F.col("l_linestatus") == "F").alias("f"))
    total = F.count("*").over(Window.partitionBy("l_orderkey"))
    chunks = lines.select(
        F.col("l_orderkey").alias("bulk_import_id"), F.col("l_linenumber").cast("long").alias("sequence"), F.when(F.col("f"), "completed").otherwise("processing").alias("status"), total.alias("total")
    )
    folder, chunks = work_folder(spark), through_table(chunks)
    for lot in range(2):
        chunks.where(F.pmod("sequence", F.lit(2)) == lot).write.mode("append").parquet(f"{folder}/in")
        out = _drained(barrier_stream(table_stream(spark, f"{folder}/in")), folder)
    return out


def _drained(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream with keyed state has written once all its files are read."""
    spark = stream.sparkSession
    with settings(spark, STORE):
        query_ = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query(f"""
with k as (select l_orderkey, l_linenumber, bool_or(l_linestatus = 'F') as f from lineitem group by 1, 2),
t as (select l_orderkey, cast(count(*) as bigint) as chunks from k group by 1 having bool_and(f))
select o_orderkey as bulk_import_id, chunks from (select *, {ORDER_STATUS_SQL} as status from orders) join t on o_orderkey = l_orderkey where status = 'validating'
""")
def orders_guarded_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stream of import states beside their lines as one of chunk states, both in two lots: a request for those that are validating and all of whose lines are finished."""
    folder = work_folder(spark)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.bool_or(F.col("l_linestatus") == "F").alias("f"))
    total = F.count("*").over(Window.partitionBy("l_orderkey"))
    chunks = lines.select(F.col("l_orderkey").alias("bulk_import_id"), F.col("l_linenumber").alias("sequence"), F.when(F.col("f"), "completed").otherwise("processing").alias("status"), total.alias("total"))
    imports = order_imports(spark, sf_dir).select("id", "status", F.lit(None).cast("long").alias("total"))
    chunks = through_table(chunks)
    for lot in range(2):
        chunks.where(F.pmod("sequence", F.lit(2)) == lot).write.mode("append").parquet(f"{folder}/chunks")
        imports.where(F.pmod(F.xxhash64("id"), F.lit(2)) == lot).write.mode("append").parquet(f"{folder}/imports")
        told, done = (table_stream(spark, f"{folder}/{name}") for name in ("imports", "chunks"))
        out = _drained(guarded_barrier(told, done), folder)
    return out


@query("""
with k as (select o_custkey, o_orderstatus = 'F' as f, cast(floor(o_totalprice) as bigint) % 100 as v from orders),
t as (select o_custkey, cast(count(*) as bigint) as t, cast(count(*) filter (where f) as bigint) as f, cast(sum(case when f then v else 0 end) as bigint) as v,
  cast(sum(case when f then v % 3 else 0 end) as bigint) as r from k group by 1)
select c_custkey as id, coalesce(t, 0) as chunks_total, coalesce(f, 0) as chunks_finished, coalesce(v, 0) as valid_rows, coalesce(r, 0) as rejected_rows,
  coalesce(f, 0) || ' of ' || coalesce(t, 0) as chunks_progress from customer left join t on c_custkey = o_custkey
""")
def customers_kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as imports, their orders as chunks that are all pending first and partly finished later: counts and sums, kept up by the changes."""
    folder = work_folder(spark)
    rows = (F.floor("o_totalprice").cast("long") % 100).alias("v")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bulk_import_id"), F.col("o_orderkey").alias("sequence"), (F.col("o_orderstatus") == "F").alias("f"), rows)
    key, none = ["bulk_import_id", "sequence"], F.lit(None).cast("long")
    begun = orders.select(*key, F.lit("pending").alias("status"), none.alias("valid_rows"), none.alias("invalid_rows"), F.lit(1).alias("version"))
    ended = orders.where("f").select(*key, F.lit("completed").alias("status"), F.col("v").alias("valid_rows"), (F.col("v") % 3).alias("invalid_rows"), F.lit(2).alias("version"))
    kept = KeptCounts(f"{folder}/kept")
    for part in (begun, ended):
        part.write.mode("append").parquet(f"{folder}/in")
        with settings(spark, STORE):
            stream = counts_stream(table_stream(spark, f"{folder}/in"), kept, f"{folder}/checkpoint")
        stream.awaitTermination()
    return kept.of_imports(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


# --- events: lifecycle, envelopes, delivery, outbox ------------------------------------------------------------

EVENT_MOVES = {"view": ("signup",), "click": ("view",), "purchase": ("click",), "error": ("signup", "view")}


def utc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


LIFECYCLE_SQL = """
with recursive e as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as rn from events),
walk as (
  select user_id, cast(0 as bigint) as rn, 'signup' as status from (select distinct user_id from events)
  union all
  select w.user_id, e.rn, case when (event_type = 'view' and status = 'signup') or (event_type = 'click' and status = 'view')
    or (event_type = 'purchase' and status = 'click') or (event_type = 'error' and status in ('signup', 'view')) then event_type else status end
  from walk w join e on e.user_id = w.user_id and e.rn = w.rn + 1
)
select user_id, arg_max(status, rn) as status from walk group by user_id
"""


@query(LIFECYCLE_SQL)
def events_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.fold(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "signup", EVENT_MOVES)


@query(LIFECYCLE_SQL)
def events_lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same changes out of order, in ten files of a stream; the last row of each key holds."""
    folder = work_folder(spark)
    utc_events(spark, sf_dir).repartition(10, F.xxhash64("event_id")).write.parquet(f"{folder}/in")
    stream = lifecycle_stream(table_stream(spark, f"{folder}/in", files_per_trigger=4), "user_id", "ts", "event_id", "event_type", "3650 days", "signup", EVENT_MOVES)
    return _drained(stream, folder).groupBy("user_id").agg(F.max_by("status", "version").alias("status"))


@query("""
with e as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as rn from events)
select user_id, event_type, event_id from e where rn = 1
""")
def events_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("key", F.struct("user_id", "event_type"))
    return lifecycle.once(events, "key", ["ts", "event_id"]).select("user_id", "event_type", "event_id")


KINDS = ("click", "error", "purchase", "signup", "view")


@query("select user_id, 'consent.import.assemble' as routing_key from events group by user_id having count(distinct event_type) = 5")
def events_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as imports with a chunk for each kind of event, finished once there is such an event."""
    seen = table(spark, sf_dir, "events").select(F.col("user_id").alias("bulk_import_id"), F.col("event_type").alias("kind"), F.lit("completed").alias("done")).distinct()
    users = seen.select("bulk_import_id").distinct()
    chunks = users.withColumn("kind", F.explode(F.array(*map(F.lit, KINDS)))).join(seen, ["bulk_import_id", "kind"], "left")
    chunks = chunks.withColumn("status", F.coalesce("done", F.lit("pending")))
    imports = users.select(F.col("bulk_import_id").alias("id"), F.lit("validating").alias("status"))
    return lifecycle.completion(imports, chunks).select(F.col("bulk_import_id").alias("user_id"), "routing_key")


ENVELOPES_SQL = """
with e as (
  select event_id, case when event_id % 7 <> 0 then null when event_id % 28 = 0 then 'Invalid message envelope: the body is not JSON'
    when event_id % 28 = 21 then 'Invalid message envelope: occurred_at is not a date'
    else 'Invalid message envelope: message_id, routing_key, occurred_at or payload is missing' end as reason, ts, event_type, user_id from events
)
"""


def event_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as envelope bodies; of every seventh one part is broken, four kinds in turn."""
    events = utc_events(spark, sf_dir)
    key = F.concat(F.lit("event."), "event_type")
    payload = F.struct(F.col("user_id").cast("string").alias("user_id"))
    good = messages.encode_body(F.concat(F.lit("m"), F.col("event_id").cast("string")), key, F.col("ts"), payload)
    kind = F.col("event_id") % 28
    body = (
        F.when(kind == 0, F.lit("{not json")).when(kind == 7, F.regexp_replace(good, '"message_id":"m([0-9]+)"', '"message_id":$1'))
        .when(kind == 14, F.regexp_replace(good, ',"payload":.*$', "}")).when(kind == 21, F.regexp_replace(good, '"occurred_at":"[^"]*"', '"occurred_at":"soon"')).otherwise(good)
    )
    return events.select("event_id", "event_type", body.alias("body"))


@query(
    ENVELOPES_SQL
    + """select event_id, reason, case when reason is null then 'm' || event_id end as message_id, case when reason is null then 'event.' || event_type end as routing_key,
    case when reason is null then epoch_us(ts) end as occurred_us, case when reason is null then cast(user_id as varchar) end as user_id from e"""
)
def events_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = messages.decode(event_bodies(spark, sf_dir))
    ok = F.col("reason").isNull()
    return got.select(
        "event_id", "reason", F.when(ok, F.col("message_id")).alias("message_id"), F.when(ok, F.col("routing_key")).alias("routing_key"),
        F.when(ok, F.unix_micros("occurred_at")).alias("occurred_us"), F.when(ok, F.get_json_object("payload", "$.user_id")).alias("user_id"),
    )


@query("""
select event_id, case event_type when 'view' then event_id % 3 <> 0 when 'click' then event_id % 3 <> 1 when 'signup' then true else false end as ok
from events
""")
def events_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload checks by routing key: fields that are empty or left out."""
    third = F.col("event_id") % 3
    key = F.create_map(*(F.lit(x) for pair in zip(("view", "click", "signup"), messages.PAYLOADS, strict=True) for x in pair))[F.col("event_type")]
    payload = F.to_json(F.struct(F.lit("1").alias("bulk_import_id"), F.when(third == 1, F.lit("")).otherwise("c").alias("chunk_id"), F.lit("k").alias("chunk_object_key"), F.when(third != 0, F.lit("s")).alias("source_object_key")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(messages.payload_ok(key, payload), F.lit(False)).alias("ok"))


@query("""
with e as (select event_id, event_id % 7 = 0 as bad, event_type = 'error' as failed, cast(event_id % 3 + 1 as int) as attempt from events),
o as (select *, case when bad then 'rejected' when not failed then 'handled' when attempt < 3 then 'retried' else 'dead_lettered' end as outcome from e)
select event_id, outcome, cast(case when outcome = 'retried' then attempt + 1 else attempt end as int) as next_attempt,
  case when outcome in ('retried', 'dead_lettered') then 'event failed' end as last_error from o
""")
def events_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = messages.decode(event_bodies(spark, sf_dir))
    tried = got.withColumns({"attempt": (F.col("event_id") % 3 + 1).cast("int"), "error": F.when(F.col("event_type") == "error", "event failed")})
    return messages.delivery(tried).select("event_id", "outcome", "next_attempt", "last_error")


@query("""
with e as (select event_id, event_id % 7 = 0 as bad, event_type = 'error' as failed from events)
select event_id, case when bad then 'rejected' when failed then 'retry' else 'handled' end as sink, cast(case when bad or not failed then 1 else 2 end as int) as next_attempt from e
""")
def events_handled_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes in two lots of a stream, given to a handler that fails on one kind of event, and what went to each sink."""
    folder = work_folder(spark)
    bodies = event_bodies(spark, sf_dir)
    fails = lambda batch: batch.withColumn("error", F.when(F.col("event_type") == "error", "event failed"))
    for lot in range(2):
        bodies.where(F.pmod("event_id", F.lit(2)) == lot).write.mode("append").parquet(f"{folder}/in")
        deliver_stream(table_stream(spark, f"{folder}/in"), fails, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    sinks = [spark.read.parquet(f"{folder}/out/{name}").select("event_id", F.lit(name).alias("sink"), "next_attempt") for name in ("handled", "retry", "rejected")]
    return sinks[0].unionByName(sinks[1]).unionByName(sinks[2])


@query("""
with e as (select event_id, event_id % 7 = 0 as bad, event_type from events)
select event_id, case when bad then 'rejected' when event_type = 'error' then 'dead' else 'handled' end as sink,
  cast(case when bad then 1 when event_type = 'error' then 3 when event_type = 'click' then 2 else 1 end as int) as attempt from e
""")
def events_retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes given to a handler that always fails on one kind of event and once on another, until no message comes back."""
    folder = work_folder(spark)
    event_bodies(spark, sf_dir).write.parquet(f"{folder}/in")
    fails = (F.col("event_type") == "error") | ((F.col("event_type") == "click") & (F.col("attempt") == 1))
    handler = Handler(lambda batch: batch.withColumn("error", F.when(fails, "event failed")))
    until_settled(lambda: deliver_with_retries(table_stream(spark, f"{folder}/in"), handler, f"{folder}/out", f"{folder}/checkpoint"))
    sinks = [spark.read.parquet(f"{folder}/out/{name}").select("event_id", F.lit(name).alias("sink"), F.col("attempt").cast("int").alias("attempt")) for name in ("handled", "dead", "rejected")]
    return sinks[0].unionByName(sinks[1]).unionByName(sinks[2])


BINDINGS = (("events", "event.view", "views"), ("events", "event.click", "clicks"), ("events", "event.click", "audit"), ("events", "event.purchase", "audit"), ("other", "event.signup", "none"))


@query("""
with b(exchange, routing_key, queue) as (values ('events', 'event.view', 'views'), ('events', 'event.click', 'clicks'), ('events', 'event.click', 'audit'),
  ('events', 'event.purchase', 'audit'), ('other', 'event.signup', 'none'))
select event_id, queue from events join b on exchange = 'events' and routing_key = 'event.' || event_type
""")
def events_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = table(spark, sf_dir, "events").select("event_id", F.lit("events").alias("exchange"), F.concat(F.lit("event."), "event_type").alias("routing_key"))
    return messages.route(sent, spark.createDataFrame(BINDINGS, "exchange string, routing_key string, queue string")).select("event_id", "queue")


def event_outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as outbox rows, their ids in time order; every third is published an hour after it was made."""
    events = utc_events(spark, sf_dir)
    published = F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.expr("interval 1 hour"))
    return events.select(
        F.format_string("%012d", "event_id").alias("id"), F.lit(0).alias("failed_attempts"), F.lit(None).cast("string").alias("last_error"), F.col("ts").alias("created_at"), published.alias("published_at"), "value"
    )


@query("""
with b as (select event_id, value, row_number() over (order by event_id) as n from events where event_id % 3 <> 0 qualify n <= 100),
f as (select *, min(case when value > 60 then n end) over () as first from b)
select lpad(cast(event_id as varchar), 12, '0') as id, case when first is null or n < first then 'published' when n = first then 'failed' else 'waiting' end as state,
  cast(case when n = first then 1 else 0 end as int) as failed_attempts, case when n = first then 'not reachable' end as last_error from f
""")
def events_outbox_relay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.relay(event_outbox(spark, sf_dir), F.col("value") > 60, 100).select("id", "state", "failed_attempts", "last_error")


@query("""
with m as (select max(ts) as latest from events)
select lpad(cast(event_id as varchar), 12, '0') as id from events, m where event_id % 3 <> 0 or ts + interval 1 hour >= latest - interval 7 day
""")
def events_outbox_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    outbox = event_outbox(spark, sf_dir)
    latest = outbox.agg(F.max("created_at").alias("latest"))
    # one row, so the join is with a constant
    return messages.prune(outbox.join(F.broadcast(latest)), F.col("latest")).select("id")


@query("select 'm' || event_id as message_id, event_type from events")
def events_dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and replays of every twentieth, as a stream of files; each message once."""
    sent = utc_events(spark, sf_dir).select(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"), "event_type", "ts")
    folder = work_folder(spark)
    sent.unionByName(sent.where(F.xxhash64("message_id") % 20 == 0)).write.parquet(f"{folder}/in")
    once = dedup_stream(table_stream(spark, f"{folder}/in"), "ts", "1 hour")
    once.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(once.schema).parquet(f"{folder}/out").select("message_id", "event_type")


@query("select 'm' || event_id as message_id, event_type from events")
def events_once_for_ever(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in four files of a stream, and in a fifth one replays of every twentieth of them all; each message once."""
    sent = table(spark, sf_dir, "events").select(F.concat(F.lit("m"), F.col("event_id").cast("string")).alias("message_id"), "event_type", "event_id")
    folder = work_folder(spark)
    for k in range(5):
        part = sent.where(F.pmod("event_id", F.lit(4)) == k) if k < 4 else sent.where(F.xxhash64("message_id") % 20 == 0)
        part.drop("event_id").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    write = lambda new, batch_id: new.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
    ids = HandledIds(f"{folder}/ids", buckets=16)
    once_stream(table_stream(spark, f"{folder}/in", files_per_trigger=1), ids, write, f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("message_id", "event_type")


@query("select 'events' as exchange, 'event.' || event_type as routing_key, cast(count(*) as bigint) as n, cast(count(distinct event_id) as bigint) as n_ids from events group by event_type")
def events_outbox_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbox rows of all events have ids of their own, the same in every run."""
    made = utc_events(spark, sf_dir).select(
        F.lit("events").alias("exchange"), F.concat(F.lit("event."), "event_type").alias("routing_key"), F.to_json(F.struct("event_id", "user_id")).alias("payload"), F.col("ts").alias("created_at")
    )
    return messages.unpublished(messages.outbox_rows(made)).groupBy("exchange", "routing_key").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"))
