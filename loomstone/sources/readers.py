"""Sources: every reader takes an explicit schema and fails on what doesn't fit it."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The columns of a corpus table, all text (fixed values of the format).
CORPUS_COLUMNS = (
    "source record_id question_id provider_id title abstract authors year venue publication_types doi dedup_identity source_url classification observability "
    "fulltext_locator_status fulltext_locator raw_source_path raw_source_sha256 extracted_effect_value extracted_effect_status decision_authority clinical_claim_allowed status"
).split()
CORPUS = ", ".join(f"{c} string" for c in CORPUS_COLUMNS)
DECISION = ("record_id string, question_id string, decision string, reason_codes array<string>, confidence string, evidence_basis string, status string")
ROUND = ("round int, judgments array<struct<record_id:string,question_id:string,decision:string,reason_codes:array<string>,confidence:string,note:string>>")


def read_csv(spark: SparkSession, path: str, schema: str = CORPUS) -> DataFrame:
    """Quoted CSV with header, cells that hold newlines, and a byte-order mark or not; blanks are empty text, not null."""
    schema = StructType.fromDDL(schema)
    rows = spark.read.schema(schema).options(header=True, multiLine=True, escape='"', enforceSchema=False, mode="FAILFAST", maxCharsPerColumn=-1).csv(path)
    return rows.select(*(F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name) for f in schema.fields))


def ordered(rows: DataFrame, column: str, values: list[str], *then: str) -> DataFrame:
    """Rows in the order in which values lists a column's values."""
    return rows.orderBy(F.array_position(F.array(*map(F.lit, values)), F.col(column)), *then)


def read_jsonl(spark: SparkSession, path: str, schema: str = DECISION) -> DataFrame:
    """One object a line; blank lines are skipped, other lines that are no such object fail."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole files, each an object or a list of objects; the schema is read from them only where none is given."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_rounds(spark: SparkSession, path: str) -> DataFrame:
    """Judgments of all rounds, with the number of the round in the file's name."""
    number = F.regexp_extract(F.input_file_name(), r"round_(\d+)\.json", 1).cast("int")
    return read_json(spark, path, ROUND).withColumn("file_round", number).select("file_round", F.inline("judgments"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """An inventory of files below a folder: path, sha256, bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Lines of `sha256  name`; names that leave the folder are marked unsafe."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    digest, name = (F.regexp_extract("value", r"^([0-9a-f]{64})  (.+)$", k) for k in (1, 2))
    return lines.select(digest.alias("sha256"), name.alias("name"), ((digest != "") & ~name.rlike(r"(^|/)\.\.(/|$)|^/")).alias("safe"))


def ledger_differences(ledger: DataFrame, files: DataFrame) -> DataFrame:
    """Ledger entries (name, sha256) against files (name, sha256): changed or missing."""
    both = ledger.alias("l").join(files.alias("f"), "name", "left")
    state = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("f.sha256") != F.col("l.sha256"), "changed").otherwise("same")
    return both.select("name", state.alias("state"))


def date_slices(start: Column, end: Column, unit: str = "month") -> Column:
    """Closed intervals of a unit (year, month or day) that make up start to end."""
    starts = F.sequence(F.trunc(start, unit) if unit != "day" else start, end, F.expr(f"interval 1 {unit}"))
    last = {"year": lambda d: F.date_sub(F.add_months(d, 12), 1), "month": F.last_day, "day": lambda d: d}[unit]
    return F.transform(starts, lambda d: F.struct(F.greatest(d, start).alias("first"), F.least(last(d), end).alias("last")))


def _text(element: ElementTree.Element | None) -> str:
    return " ".join("".join(element.itertext()).split()) if element is not None else ""


def _author(author: ElementTree.Element) -> str:
    """A group's name, or family name and initials."""
    return _text(author.find("CollectiveName")) or " ".join(p for p in (_text(author.find("LastName")), _text(author.find("Initials"))) if p)


def _article(item: ElementTree.Element) -> dict:
    sections = [(f"{label}: " if (label := s.get("Label")) else "") + _text(s) for s in item.iterfind(".//Abstract/AbstractText")]
    ids = {i.get("IdType", "").lower(): _text(i) for i in item.iterfind(".//ArticleId")}
    years = (_text(item.find(p)) for p in (".//JournalIssue/PubDate/Year", ".//PubDate/MedlineDate", ".//ArticleDate/Year", ".//Book/PubDate/Year", ".//DateCompleted/Year"))
    kinds = dict.fromkeys(_text(k) for k in item.iterfind(".//PublicationType"))
    return {
        "provider_id": _text(item.find(".//PMID")),
        "title": _text(item.find(".//ArticleTitle")) or _text(item.find(".//BookTitle")),
        "abstract": "\n".join(s for s in sections if s),
        "venue": _text(item.find(".//Journal/Title")),
        "year": next((y[:4] for y in years if y), ""),
        "publication_types": "|".join(k for k in kinds if k),
        "doi": ids.get("doi", ""),
        "pmc": ids.get("pmc", ""),
        "authors": "; ".join(a for a in map(_author, item.iterfind(".//AuthorList/Author")) if a),
    }


ARTICLE = "path string, provider_id string, title string, abstract string, venue string, year string, publication_types string, doi string, pmc string, authors string"


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles and books of bibliographic XML files, with text of mixed content in document order; those without an id are left out."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                root = ElementTree.fromstring(content)
                found = [{"path": name} | a for x in root if x.tag in ("PubmedArticle", "PubmedBookArticle") if (a := _article(x))["provider_id"]]
                if found:
                    columns = ARTICLE.replace(" string", "").split(", ")
                    yield pa.RecordBatch.from_pydict({c: pa.array([f[c] for f in found], pa.string()) for c in columns})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, ARTICLE)


def id_differences(asked: DataFrame, found: DataFrame) -> DataFrame:
    """Ids (provider_id) that were asked for and not found (missing) or found unasked (extra); none if the sets are equal."""
    sides = asked.select("provider_id", F.lit(1).alias("a"), F.lit(0).alias("f")).unionByName(found.select("provider_id", F.lit(0).alias("a"), F.lit(1).alias("f")))
    sets = sides.groupBy("provider_id").agg(F.max("a").alias("a"), F.max("f").alias("f")).filter("a != f")
    return sets.select("provider_id", F.when(F.col("a") == 1, "missing").otherwise("extra").alias("state"))


TERMS = "MedlineCitation struct<PMID:struct<_VALUE:string>,MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_VALUE:string>>>>>"


def read_terms(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Indexing terms of each article of bibliographic XML files: provider_id, terms (joined by ;). Of several records of one id, the first by file and place counts.

    Files are cut at articles and parsed one article at a time in the JVM, and of an article only id and terms are kept, so a file of any size takes little memory and many
    tasks. With wanted (provider_id), other articles go before anything is shuffled, by a semi join that Spark broadcasts if it knows wanted to be small.
    """
    scan = spark.read.format("xml").option("rowTag", "PubmedArticle").schema(TERMS).load(path)
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    headings = F.coalesce("MedlineCitation.MeshHeadingList.MeshHeading", F.array().cast("array<struct<DescriptorName:struct<_VALUE:string>>>"))
    terms = F.filter(F.transform(headings, lambda h: strip(h["DescriptorName"]["_VALUE"])), lambda t: t != "")
    place = F.struct(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = scan.select(strip(F.col("MedlineCitation.PMID._VALUE")).alias("provider_id"), F.array_join(terms, ";").alias("terms"), place.alias("place")).filter("provider_id != ''")
    if wanted is not None:
        rows = rows.join(wanted.select("provider_id").distinct(), "provider_id", "left_semi")
    return rows.groupBy("provider_id").agg(F.min_by("terms", "place").alias("terms"))


def read_ris(spark: SparkSession, path: str) -> DataFrame:
    """RIS records: one row for each record with its tags as a map of lists."""
    whole = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    records = whole.select("path", F.posexplode(F.split("value", r"(?m)^ER  -.*$")).alias("record", "body")).filter(F.col("body").rlike(r"(?m)^TY  -"))
    tags = records.select("path", "record", F.explode(F.split("body", r"\r?\n")).alias("line")).select("path", "record", F.regexp_extract("line", r"^([A-Z][A-Z0-9])  - ?(.*)$", 1).alias("tag"), F.regexp_extract("line", r"^([A-Z][A-Z0-9])  - ?(.*)$", 2).alias("value"))
    lists = tags.filter("tag != ''").groupBy("path", "record", "tag").agg(F.collect_list("value").alias("values"))
    return lists.groupBy("path", "record").agg(F.map_from_entries(F.collect_list(F.struct("tag", "values"))).alias("tags"))
